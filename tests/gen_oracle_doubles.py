"""Regenerate riskweave/plans/oracle_doubles.py from the catalog's output schemas (run at sf0.001)."""
import os
import pprint
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import types as T  # noqa: E402

from riskweave.plans import catalog as C  # noqa: E402
from riskweave.session import get_session  # noqa: E402


def main(sf_dir: str = "/root/testdata/sf0.001") -> None:
    spark = get_session("local[4]", shuffle_partitions=4)
    out = {}
    for name in sorted(C.ORACLE):
        df = C.QUERIES[name](spark, sf_dir)
        out[name] = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    path = os.path.join(os.path.dirname(C.__file__), "oracle_doubles.py")
    with open(path, "w") as fh:
        fh.write('"""Double-typed output columns per oracle query (static schema metadata of the catalog).\n\n'
                 'Both engines apply the same final contract rounding to exactly these columns.\n'
                 'Regenerate with tests/gen_oracle_doubles.py after changing a query\'s schema.\n"""\n\n')
        fh.write("DOUBLE_COLUMNS = " + pprint.pformat(out, width=110, compact=True) + "\n")


if __name__ == "__main__":
    main(*sys.argv[1:])
