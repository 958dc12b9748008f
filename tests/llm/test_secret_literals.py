"""Literals under single sensitive words, under annotated names and with blanks."""
import pytest

from riskweave.llm import secrets


def found(text):
    return [text[a:b] for a, _, b in secrets.literal_spans(text)]


@pytest.mark.parametrize("text", [
    'DB_PASS = "Zx81kqLmP0"', "SMTP_PASS: 'Zx81kqLmP0'", 'auth: "Zx81kqLmP0"', 'bearer = "Zx81kqLmP0"', 'client_key = "Zx81kqLmP0"',
    "DB_PASS=Zx81kqLmP0", 'api_key: str = "Zx81kqLmP0"', 'const token: string = "Zx81kqLmP0";', 'let token: &str = "Zx81kqLmP0";',
    "let token: &'static str = \"Zx81kqLmP0\";", 'secret: Optional[str] = "Zx81kqLmP0"', 'token: str | None = "Zx81kqLmP0"',
    'token: std::string = "Zx81kqLmP0"', "KEY = 'Zx81kqLmP0'\npassword: str = KEY", 'private token?: string="Zx81kqLmP0"',
    'def f(user: str = "a", token: str = "Zx81kqLmP0", n: int = 1):',
])
def test_literal_is_found(text):
    assert found(text) == ["Zx81kqLmP0"]


def test_blanks_and_long_single_words():
    assert found('passphrase = "correct horse battery staple"') == ["correct horse battery staple"]
    assert found('PASS_PHRASE: "correct horse battery staple"') == ["correct horse battery staple"]
    assert found('salt = "9fK2mQ7xTz4LpW8c"') == ["9fK2mQ7xTz4LpW8c"]
    assert found("password: abc=Zx81kqLmP0") == ["abc=Zx81kqLmP0"]  # a value, no type
    assert found("token: Zx81kqLmP0==\n") == ["Zx81kqLmP0=="]


@pytest.mark.parametrize("text", [
    'auth: "required"', 'password: "please type a word"', 'key: "background-color"', "key = hash_table_entry32", 'api_key: str = "changeme"',
    "auth = make_session_v2", 'client = "Zx81kqLmP0abcdef123"', 'api_key: str = None', "token: string;", 'bearer = "aaaaaaaaaaaa1"',
])
def test_no_literal(text):
    assert found(text) == []


@pytest.mark.parametrize("text", [
    "<password>Zx81kqLmP0</password>", '<db:password type="plain">\n  Zx81kqLmP0\n</db:password>', 'token = """Zx81kqLmP0"""',
    "token = \'\'\'Zx81kqLmP0\'\'\'", "const token = `Zx81kqLmP0`;", "run --password Zx81kqLmP0 --verbose", "run --api-token='Zx81kqLmP0'",
    'client.set_password("Zx81kqLmP0")', "builder.withToken('Zx81kqLmP0')", 'auth = os.getenv("AUTH_VALUE_1", "Zx81kqLmP0")',
    'auth = os.environ.get("AUTH_VALUE_1", "Zx81kqLmP0")', 'const secret = process.env || "Zx81kqLmP0"', 'auth = given or "Zx81kqLmP0"',
    'password = b"Zx81kqLmP0"', "K = 'Zx81kqLmP0'\nuser.setPassword(K)", "K = 'Zx81kqLmP0'\nlogin --password K", "a" * 300 + '_password = "Zx81kqLmP0"',
])
def test_literal_is_found_in_further_forms(text):
    assert found(text) == ["Zx81kqLmP0"]


def test_joined_constants_count_as_a_whole():
    assert found('K = "Zx81kq"; L = K + "LmP0qq"; auth_token = L') == ["Zx81kq", "LmP0qq"]
    assert found('K = "Zx81"\nL = K+"kqLm"\nM = L + "P0qq"\npassword = M') == ["Zx81", "kqLm", "P0qq"]
    assert found('token = "Zx81" + "" + "kqLmP0"') == ["Zx81", "kqLmP0"]
    assert found('token = "Zx81" + suffix') == []                      # a part is not known
    assert found('auth = "Bearer " + "Zx81kqLmP0"') == ["Zx81kqLmP0"]  # blanks in the whole: parts are scored alone
    assert found('K = "ab"\n' + "K = K + K\n" * 200 + "token = K") == []


@pytest.mark.parametrize("text", [
    'token = os.getenv("API_TOKEN_V2X")', "pass --password required on the line", "<token>short</token>", "<password></password>",
    'set_token("session_id_2024", 4)', 'token = """"', "--password", 'reset_password("Zx81kqLmP0")', "x = `Zx81kqLmP0`",
])
def test_no_literal_in_further_forms(text):
    assert found(text) == []


def test_long_hostile_texts_take_linear_time():
    for text in ("a" * 400_000 + "_token", 'x = """' * 40_000, "<a " * 100_000, "--a " * 100_000, "<key>" * 80_000, "token" + " " * 300_000):
        assert secrets.literal_spans(text) == []
