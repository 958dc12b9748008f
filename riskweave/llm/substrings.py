"""Repeated byte strings by a sampled suffix array.

A byte goes if it lies in a string of ``length`` (400) bytes that also starts anywhere else. The
suffixes of all texts that start at *anchors* are sorted: an anchor is the position whose 16-byte
hash is smallest in a window of length - 15 positions, so every string of 400 bytes has one anchor
(its first smallest) and equal strings have it at the same place. About one position in 190 is an
anchor, and each anchor stands for the run of suffixes (starts) whose 400 bytes choose it.

1. *Candidates*: a repeated string holds a repeated half around its anchor (the ``HALF`` bytes from it,
   or the ``HALF`` bytes before its 16th). Counts of half hashes, pre-aggregated in every task, leave the anchors with a
   repeated half; all others stand for unrepeated strings only.
2. *Suffix sort*: contexts (all bytes of a run of strings) are range-partitioned by their leading tokens, the bytes at
   the anchor, between splitters sampled from all contexts. A splitter may fall inside a hot key. Inside a bucket contexts
   with the same bytes collapse to one row, whose strings are all repeated, and the suffixes of the distinct ones are sorted by
   multikey quicksort on their own bytes, eight to a token: a suffix is read as far as it is tied. Neighbours
   whose tokens are all equal are equal strings, byte for byte.
3. *Boundaries*: equal strings of a key that was cut (more than ``KEY_ROWS`` contexts) may lie in several buckets. Of such keys each
   bucket sends the suffixes it has not matched, and one of each repeated string, as two 64-bit hashes (of half and place, and of
   the 400 bytes); counts compare them across buckets. A wrong match there needs both hashes to collide.
4. Repeated starts return to their documents as runs and the bytes they cover are removed.

Texts move once (to meet their spans), contexts of candidates once, a row for each copy; anchors move as hashes.

Defined results: null text counts as empty; texts under 400 bytes have nothing to remove; matches never
cross documents; repeated rows are documents of their own (told apart by a row number); an empty
table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm import text as T
from riskweave.session import ensure_checkpoint_dir

LENGTH = 400
GRAM = 16
#: Contexts of one key that a bucket takes whole; a key with more is cut, and compared across the cuts.
KEY_ROWS = 20_000
_UNIT = "did long, tid long, side int, first int, n int, off int, half long"
_SIDE = np.array([0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = T.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(T._BYTE[data] * up[:-1], out=total[1:])
    return total, down


def anchors(data: np.ndarray, offs: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Units (row, side, first, n, off, half) of the texts: half a run of starts around each anchor."""
    width = length - GRAM + 1
    none = {k: np.zeros(0, np.uint64 if k == "half" else np.int64) for k in ("row", "side", "first", "n", "off", "half")}
    if len(data) < length:
        return none
    total, down = _prefix(data)
    size = len(data) - GRAM + 1
    key = (total[GRAM:] - total[:-GRAM]) * down[:size]
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0x94D049BB133111EB)
    key &= np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(size, dtype=np.uint64)  # ties: the first position
    blocks = np.full(-(-size // width) * width, np.uint64(2**64 - 1))
    blocks[:size] = key
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    step = np.zeros(len(data) + 1, np.int32)
    long = np.flatnonzero(np.diff(offs) >= length)
    if not len(long):
        return none
    step[offs[long]] += 1
    np.add.at(step, offs[long + 1] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(step[:size - width + 1]))
    at = (np.minimum(behind[start], ahead[start + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    at, low, high = at[new], start[new], start[np.append(new[1:], len(start)) - 1]
    reach = (length + GRAM) // 2  # bytes of a half; a string holds one of the two halves at its anchor
    back = reach - GRAM
    parts = []
    for side, a, b in ((0, np.maximum(low, at - back), high), (1, low, np.minimum(high, at - back - 1))):
        ok = np.flatnonzero(a <= b)
        p = at[ok]
        lo = p if side == 0 else p - back
        half = T.mix((total[lo + reach] - total[lo]) * down[lo]) ^ _SIDE[side]
        row = np.searchsorted(offs, p, "right") - 1
        parts.append((row, np.full(len(ok), side), a[ok] - offs[row], b[ok] - a[ok] + 1, p - a[ok], half))
    return {k: np.concatenate([x[i] for x in parts]) for i, k in enumerate(none)}


def _units(length: int):
    def run(batches):
        for batch in batches:
            did, tid = batch.column(0), batch.column(1)
            for first, _, data, offs in T.chunks(batch.column(2), 1 << 19):
                u = anchors(data, offs, length)
                row = pa.array(u["row"] + first)
                yield pa.RecordBatch.from_arrays(
                    [did.take(row), tid.take(row), *(pa.array(u[k].astype(np.int32)) for k in ("side", "first", "n", "off")),
                     pa.array(u["half"].view(np.int64))], ["did", "tid", "side", "first", "n", "off", "half"])
    return run


def _contexts(length: int):
    """Rows (did, tid, text, units) to one row a unit with its bytes and the token at its anchor."""
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out, refs, lead, bytes_ = [], [], [], []
                for row, (text, units) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    raw = text.encode()
                    for u in units:
                        a = u["first"]
                        refs.append(row)
                        out.append(u)
                        bytes_.append(raw[a:a + u["n"] - 1 + length])
                        lead.append(int.from_bytes(raw[a + u["off"]:a + u["off"] + 8], "big", signed=True))
                row = pa.array(refs, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lead, pa.int64()), pa.array([u["half"] for u in out], pa.int64()),
                     pa.array([u["salt"] for u in out], pa.int32()), pa.array([u["cut"] for u in out], pa.bool_()),
                     part.column(0).take(row), part.column(1).take(row),
                     *(pa.array([u[k] for u in out], pa.int32()) for k in ("first", "n", "off")), pa.array(bytes_, pa.binary())],
                    ["lead", "half", "salt", "cut", "did", "tid", "first", "n", "off", "bytes"])
    return run


def multikey_order(tokens) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): positions sorted by the tokens in turn, and whether each equals the one before it in all of them.

    Multikey quicksort: each token (an array, or a function from positions to values) is read for the suffixes still tied, and
    only groups that it splits are sorted.
    """
    order = same = None
    for token in tokens:
        read = token if callable(token) else token.__getitem__
        if order is None:
            first = read(slice(None))
            order = np.argsort(first)
            same = np.concatenate(([False], first[order][1:] == first[order][:-1]))[:len(order)]
            continue
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        value = read(order[at])
        group = np.cumsum(~same[at])
        differs = same[at] & np.concatenate(([False], value[1:] != value[:-1]))
        split = np.zeros(group[-1] + 1, bool)
        split[group[differs]] = True
        mixed = np.flatnonzero(split[group])
        if len(mixed):
            to = mixed[np.lexsort((value[mixed], group[mixed]))]
            order[at[mixed]], value[mixed] = order[at[to]], value[to]
            same[at[mixed]] &= np.concatenate(([False], value[1:] == value[:-1]))[mixed]
    return order, same


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number (big-endian)."""
    word = np.zeros(max(0, len(data) - 7), np.uint64)
    for k in range(8):
        word <<= np.uint64(8)
        word |= data[k:k + len(word)]
    return word


def _bucket(length: int):
    """Sorted contexts of a bucket to repeated runs (sure), and what cut keys must compare across buckets."""
    names = ["did", "tid", "start", "end", "w1", "w2", "sure"]

    def compare(t: pa.RecordBatch) -> pa.RecordBatch:
        half, cut, first, n, off = (t.column(k).to_numpy(zero_copy_only=False) for k in (1, 3, 6, 7, 8))
        half, first, n, off = half.view(np.uint64), first.astype(np.int64), n.astype(np.int64), off.astype(np.int64)
        data, offs = T.string_buffers(t.column(9))
        data, offs = data[offs[0]:offs[-1]], offs - offs[0]
        index = t.column(9).dictionary_encode().indices.to_numpy()
        _, rep, back, count = np.unique(index, return_index=True, return_inverse=True, return_counts=True)
        # suffixes of the distinct contexts
        size = n[rep]
        done = np.cumsum(size) - size
        of = np.repeat(np.arange(len(rep)), size)
        place = np.arange(len(of)) - done[of]
        start = offs[rep][of] + place
        word = _words(data)
        places = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
        order, same = multikey_order([lambda at, k=k: word[start[at] + k] for k in places])
        repeated = np.zeros(len(of), bool)
        repeated[order] = same
        repeated[order[:-1]] |= same[1:]
        again = repeated | (count > 1)[of]
        # runs of repeated starts: those of single contexts, and whole contexts that have copies
        single = again & (count == 1)[of]
        head = np.flatnonzero(single & ((place == 0) | ~np.concatenate(([False], single[:-1]))))
        tail = np.flatnonzero(single & ((place == size[of] - 1) | ~np.concatenate((single[1:], [False]))))
        copies = np.flatnonzero((count > 1)[back])
        row = np.concatenate([rep[of[head]], copies])
        a = np.concatenate([first[rep[of[head]]] + place[head], first[copies]])
        b = np.concatenate([first[rep[of[head]]] + place[tail], first[copies] + n[copies] - 1]) + length
        out = [(row, a, b, T.mix(row.astype(np.uint64) + np.uint64(1)), T.mix(a.astype(np.uint64)), True)]
        across = np.flatnonzero(cut[rep][of])
        if len(across):
            total, down = _prefix(data)

            def hashes(at):
                place_hash = (off[rep][of[at]] - place[at] + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                return T.mix(half[rep][of[at]] + place_hash), T.mix((total[start[at] + length] - total[start[at]]) * down[start[at]])

            lone = across[~again[across]]
            out.append((rep[of[lone]], first[rep[of[lone]]] + place[lone], first[rep[of[lone]]] + place[lone] + length,
                        *hashes(lone), False))
            one = np.zeros(len(of), bool)
            one[order] = ~same  # one of each distinct suffix that is known to repeat here
            known = across[(again & one)[across]]
            out.append((np.full(len(known), -1), np.zeros(len(known), np.int64), np.zeros(len(known), np.int64), *hashes(known), False))
        parts = []
        for r, s, e, w1, w2, sure in out:
            at = pa.array(r, pa.int64(), mask=np.asarray(r) < 0)
            parts.append(pa.RecordBatch.from_arrays(
                [t.column(4).take(at), t.column(5).take(at), pa.array(s, pa.int64()), pa.array(e, pa.int64()),
                 pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(np.full(len(r), sure))], names))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            key = [batch.column(k) for k in (0, 1, 2)]
            last = tuple(c[batch.num_rows - 1].as_py() for c in key)
            cut = batch.num_rows - 1
            lead, half, salt = (c.to_numpy() for c in key)
            other = np.flatnonzero((lead != last[0]) | (half != last[1]) | (salt != last[2]))
            cut = int(other[-1]) + 1 if len(other) else 0
            before = held[-2] if len(held) > 1 else None
            if cut == 0 and before is not None and tuple(before.column(k)[before.num_rows - 1].as_py() for k in (0, 1, 2)) != last:
                held, ready = [batch], held[:-1]
            elif cut:
                held, ready = [batch.slice(cut)], [*held[:-1], batch.slice(0, cut)]
            else:
                continue
            yield from compare(pa.Table.from_batches(ready).combine_chunks().to_batches()[0])
        if held:
            yield from compare(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
    return run


def _without(batches):
    """Rows (doc_id, text, runs) to sizes, and the digest and text of what stays."""
    for batch in batches:
        sizes, gone, spans, digests, texts = [], [], [], [], []
        for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw, merged, kept, at = text.encode(), [], [], 0
            for r in sorted(runs or [], key=lambda r: (r["start"], r["end"])):
                if merged and r["start"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r["end"])
                else:
                    merged.append([r["start"], r["end"]])
            for a, b in merged:
                kept.append(raw[at:a])
                at = b
            rest = b"".join([*kept, raw[at:]])
            sizes.append(len(raw))
            gone.append(sum(b - a for a, b in merged))
            spans.append(len(merged))
            digests.append(hashlib.sha256(rest).hexdigest())
            texts.append(rest.decode(errors="replace"))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, gone, spans)), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])


def repeated_substrings(docs: DataFrame, length: int = LENGTH, key_rows: int = KEY_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) for each row of docs (doc_id, text).

    text is what stays; a character that a removal cut in two shows as U+FFFD (the digest is of the bytes).
    """
    spark: SparkSession = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("did"), F.xxhash64("text").alias("tid"))
    path = f"{ensure_checkpoint_dir(spark)}/anchors-{uuid.uuid4().hex}"
    base.select("did", "tid", "text").mapInArrow(_units(length), _UNIT).write.parquet(path)
    units = spark.read.schema(_UNIT).parquet(path)
    counts = units.groupBy("half").agg(F.count("*").alias("n_half")).where("n_half > 1")
    salt = F.pmod(F.xxhash64("did", "tid", "first"), F.ceil(F.col("n_half") / key_rows)).cast("int")
    wanted = (units.join(counts, "half").withColumn("salt", salt).withColumn("cut", F.col("n_half") > key_rows)
              .groupBy("did", "tid").agg(F.collect_list(F.struct("first", "n", "off", "half", "salt", "cut")).alias("units")))
    texts = base.repartition(parts, "did", "tid")  # moved once, read by both joins
    # all columns of texts are taken along, so that both joins have the same exchange
    contexts = texts.join(wanted, ["did", "tid"]).select("did", "tid", "text", "units", "doc_id").mapInArrow(
        _contexts(length), "lead long, half long, salt int, cut boolean, did long, tid long, first int, n int, off int, bytes binary")
    found = (contexts.repartitionByRange(parts, "lead", "half", "salt").sortWithinPartitions("lead", "half", "salt")
             .mapInArrow(_bucket(length), "did long, tid long, start long, end long, w1 long, w2 long, sure boolean"))
    runs = (found.withColumn("seen", F.count("*").over(Window.partitionBy("w1", "w2", "sure")))  # at most one row a bucket
            .where("did is not null and (sure or seen > 1)")
            .groupBy("did", "tid").agg(F.collect_list(F.struct("start", "end")).alias("runs")))
    return texts.join(runs, ["did", "tid"], "left").select("doc_id", "text", "runs").mapInArrow(
        _without, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 400 bytes in all documents."""
    return repeated_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
