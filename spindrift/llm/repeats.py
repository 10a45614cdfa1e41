"""Exact removal of repeated byte strings (operator 12): suffix buckets refined by bucket pointers.

A string of `length` bytes goes where it also starts earlier: in a smaller id, or in the same document before. Starts are
bucketed, and buckets are refined by sorting on the bucket identifiers of later offsets, until they hold equal strings:

1. Each task makes bucket identifiers of all its byte positions: 8-grams first, then those of depth 2d from the
   identifiers of depth d here and d bytes on, reused up to the full depth. The initial bucket of a start is the least
   identifier of depth q among the q-grams of its string: equal strings share it, whatever stands around them. Successive
   starts of one bucket are a run, a row of some 35 bytes' work. Runs that repeat inside of the task are settled there.
2. Runs meet by bucket. Of runs with equal bytes all but the first repeat. A bucket that keeps several different runs
   is open; so is a run in which a string may repeat itself.
3. The bytes of open runs (a few hundredths of all) are fetched and refined exactly: ranks of 8-grams, sorted by the
   ranks 8, 16, 32, 36 bytes on, only where a bucket still holds several; buckets of the full depth hold equal
   strings, and all but the first of each repeat. Runs of a wide bucket are refined to the full depth before they
   meet, a digest for each start, so that a string that a third of all documents hold is no group of one task.

Buckets in a thousandth or more of a bounded sample's runs are dealt by their content as well. It only moves work.
Memory: a task holds a piece of at most `PIECE` bytes of text (long texts are worked in pieces), or the open runs of one bucket, at most
`WIDE` of them. Runs are known by 128 bits (bucket and content), starts of wide buckets by a 128-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spindrift.llm import common

#: Bytes of text that are worked at once; runs that a bucket may have before it is refined start by start.
PIECE, WIDE = 2 << 20, 20_000
#: Text that the search for frequent buckets reads, and the share of its runs from which a bucket is frequent.
SAMPLE_BYTES, FREQUENT = 32 << 20, 1e-3
_NEW, _OWN, _KNOWN = 0, 1, 2  # a run; a run in which a string may repeat itself; a run that repeats for certain
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on; zeros stand behind the end."""
    padded = np.concatenate([data, np.zeros(7, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view("<u8").ravel()


def _deeper(ids: np.ndarray, step: int) -> np.ndarray:
    """Identifiers of the bytes from each position and from step bytes further on, out of those of either; the last step positions keep theirs."""
    out = ids.copy()
    if len(ids) > step:
        out[:-step] = _mix(ids[:-step] * _U(0x9E3779B97F4A7C15) + ids[step:])
    return out


def _depth(length: int) -> int:
    """Of the initial buckets: 8, doubled while at most half of the length."""
    q = 8
    while q * 4 <= length:
        q *= 2
    return q


def _runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int):
    """Runs of starts in the segments [begin, end) of data: (first start, number, bucket, content, may repeat itself)."""
    q = _depth(length)
    reach = length - q + 1
    ids = _mix(_words(data))
    depth = 8
    while True:
        if depth == q:
            grams = ids
        if depth * 2 > length:
            break
        ids = _deeper(ids, depth)
        depth *= 2
    whole = _deeper(ids, length - depth) if length > depth else ids
    least, span = grams.copy(), 1
    while span < reach:  # the least of reach successive q-grams
        step = min(span, reach - span)
        least[:-step] = np.minimum(least[:-step], least[step:])
        span += step
    inside = np.zeros(len(data) + 1, np.int8)
    inside[begins] += 1
    inside[ends - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    bucket = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (at[1:] != at[:-1] + 1)
    firsts = np.flatnonzero(new)
    new[(np.arange(len(at)) - np.repeat(firsts, np.diff(firsts, append=len(at)))) % reach == 0] = True
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(at)) - 1
    # equal strings of one run have different places of the least gram, so that one starts a string that isn't the run's last
    again = grams[at] == bucket
    again[lasts] = False
    own = np.logical_or.reduceat(again, firsts) if len(firsts) else np.zeros(0, bool)
    n = lasts - firsts + 1
    content = _mix(whole[at[firsts]] * _U(3) + _mix(whole[at[lasts]] + n.astype(_U)))
    return at[firsts], n, bucket[firsts], content, own


def _pieces(lengths: list[int], length: int, budget: int) -> Iterator[list[tuple[int, int, int]]]:
    """(document, begin, end) segments of at most budget bytes together; segments of one document share length - 1 bytes."""
    piece, size = [], 0
    for i, n in enumerate(lengths):
        a = 0
        while n - a >= length:
            room = max(budget - size, length)
            b = n if n - a <= room else a + room
            piece.append((i, a, b))
            size += b - a
            a = b - length + 1
            if size >= budget:
                yield piece
                piece, size = [], 0
    if piece:
        yield piece


def _packed(start, n, kind=0):
    """A run in one number: where it starts, how many starts it has (under 2^20), its kind."""
    return (start << 22) | (n << 2) | kind


def _ordered(batch: pa.RecordBatch, *names: str) -> pa.RecordBatch:
    return batch.take(pc.sort_indices(batch.select(list(names)), sort_keys=[(n, "ascending") for n in names], null_placement="at_end"))


def _located(batches: Iterator[pa.RecordBatch], length: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(id, tie, bucket, content, run) of documents (id, tie, text)."""
    for batch in batches:
        for part in common.slices(batch, "text", PIECE):
            part = _ordered(part, "id", "tie")  # places in a piece are in the order of documents
            texts = common.bytes_of(part, "text")
            for piece in _pieces([len(x) for x in texts], length, PIECE):
                sizes = np.array([b - a for _, a, b in piece])
                ends = np.cumsum(sizes)
                begins = ends - sizes
                data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in piece), np.uint8)
                at, n, bucket, content, own = _runs(data, begins, ends, length)
                order = np.lexsort((content, bucket))  # stable: the first of equal runs stays first
                known = np.zeros(len(at), bool)
                known[order[1:]] = (bucket[order[1:]] == bucket[order[:-1]]) & (content[order[1:]] == content[order[:-1]])
                segment = np.searchsorted(begins, at, side="right") - 1
                start = at - begins[segment] + np.array([a for _, a, _ in piece])[segment]
                rows = pa.array(np.array([i for i, _, _ in piece])[segment])
                kind = np.where(known, _KNOWN, np.where(own, _OWN, _NEW))
                bucket = np.where(known, _mix(content + at.astype(_U)), bucket)  # what is settled needs no bucket: anywhere
                yield pa.RecordBatch.from_arrays([part.column("id").take(rows), part.column("tie").take(rows), pa.array(bucket.view(np.int64)), pa.array(content.view(np.int64)), pa.array(_packed(start, n, kind))], schema=schema)
    common.tidy()


def _fetched(batches: Iterator[pa.RecordBatch], length: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(id, tie, bucket, run, content) of documents with open runs: the run's bytes; a digest for each start of a wide bucket; null where that start repeats."""
    for batch in batches:
        for part in common.slices(batch, "text", PIECE):
            part = _ordered(part, "id", "tie")
            texts, rows, out, seen = common.bytes_of(part, "text"), [], ([], [], []), set()
            for i, found in enumerate(part.column("open").to_pylist()):
                for x in sorted(found, key=lambda x: x["run"]):
                    start, n, text = x["run"] >> 22, x["run"] >> 2 & 0xFFFFF, texts[i]
                    if not x["wide"]:
                        made = [(x["bucket"], x["run"], text[start : start + n + length - 1])]
                    else:
                        made = []
                        for s in range(start, start + n):
                            digest = xxhash.xxh3_128_digest(text[s : s + length])
                            made.append((int.from_bytes(digest[:8], "big", signed=True), _packed(s, 1), None if digest in seen else digest))
                            seen.add(digest)
                    rows += [i] * len(made)
                    for values, new in zip(out, zip(*made), strict=True):
                        values += new
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("tie").take(at), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], schema=schema)


def refined(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each of the ascending starts whether the length bytes from there also start at an earlier one. Exact.

    Buckets of 8-grams are refined by bucket pointers of later offsets; a start that is alone in its bucket keeps its pointer.
    """
    if not len(starts):
        return np.zeros(0, bool)
    pointer = np.unique(_words(data), return_inverse=True)[1].astype(np.int64)
    active, depth = np.arange(len(data) - 8 + 1), 8
    highest = len(pointer)
    while True:
        counts = np.bincount(pointer[active] - pointer[active].min()) if len(active) else np.zeros(1, int)
        active = active[counts[pointer[active] - pointer[active].min()] > 1] if len(active) else active
        if depth == length or not len(active):
            break
        step = min(depth, length - depth)
        active = active[active + step < len(pointer)]
        _, ranks = np.unique(pointer[active] * np.int64(highest) + pointer[active + step], return_inverse=True)
        pointer[active] = ranks + highest
        highest += len(active)
        depth += step
    grouped = np.zeros(len(data), bool)
    grouped[active] = True
    found = np.flatnonzero(grouped[starts])
    repeats = np.zeros(len(starts), bool)
    repeats[found] = True
    repeats[found[np.unique(pointer[starts[found]], return_index=True)[1]]] = False
    return repeats


def _settled(batches: Iterator[pa.RecordBatch], length: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(id, tie, run) that repeat, of rows in the order of bucket, id, tie and run."""
    held: list[pa.RecordBatch] = []  # open runs, whole buckets but for the last one
    size, bucket, seen = 0, None, set()

    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks().to_batches()[0]
        rows = _ordered(rows, "id", "tie", "run")
        texts, run = rows.column("content").to_pylist(), rows.column("run").to_numpy()
        ends = np.cumsum([len(x) for x in texts])
        n = run >> 2 & 0xFFFFF
        begins = ends - n - length + 1
        row = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        again = refined(np.frombuffer(b"".join(texts), np.uint8), begins[row] + offset, length)
        row, start = row[again], ((run >> 22)[row] + offset)[again]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
        firsts = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays([rows.column("id").take(at := pa.array(row[firsts])), rows.column("tie").take(at), pa.array(_packed(start[firsts], np.diff(firsts, append=len(row))))], schema=schema)

    for batch in batches:
        content = batch.column("content")
        lengths = pc.fill_null(pc.binary_length(content), 0).to_numpy(zero_copy_only=False)
        gone = lengths == 0
        for i in np.flatnonzero(lengths == 16):  # digests; runs have at least 17 bytes
            b, digest = batch.column("bucket")[i].as_py(), content[i].as_py()
            if b != bucket:
                bucket, seen = b, set()
            gone[i] = digest in seen
            seen.add(digest)
        if gone.any():
            yield batch.filter(pa.array(gone)).select(["id", "tie", "run"]).cast(schema)
        runs = batch.filter(pa.array(lengths > 16))
        if not runs.num_rows:
            continue
        held.append(runs)
        size += int(lengths[lengths > 16].sum())
        while size >= PIECE:
            rows = pa.Table.from_batches(held)
            buckets = rows.column("bucket").to_numpy()
            sizes = np.cumsum(pc.binary_length(rows.column("content")).to_numpy())
            # up to the last border of buckets within the piece, or to the first one at all
            borders = np.flatnonzero(buckets[1:] != buckets[:-1]) + 1
            fit = borders[sizes[borders - 1] <= PIECE]
            if not len(borders):
                break
            cut = int(fit[-1] if len(fit) else borders[0])
            yield solve(rows.slice(0, cut))
            held, size = rows.slice(cut).to_batches(), int(sizes[-1] - sizes[cut - 1])
    if held:
        yield solve(pa.Table.from_batches(held))
    common.tidy()


def _frequent(docs: DataFrame, located, total: int) -> list[int]:
    """Buckets with a thousandth or more of the runs of a sample of about SAMPLE_BYTES; so at most a thousand."""
    share = min(1.0, SAMPLE_BYTES / max(total, 1))
    runs = located(docs.sample(share, seed=12) if share < 1 else docs).where(F.col("run").bitwiseAND(3) != _KNOWN).groupBy("bucket").count()
    most = runs.agg(F.sum("count")).first()[0] or 0
    return [r[0] for r in runs.where(F.col("count") >= max(50, most * FREQUENT)).collect()]


def repeats(docs: DataFrame, length: int = 100, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without the bytes that strings of `length` bytes cover which also start earlier.

    Returns a row for each row of docs: id, copies' number `nth`, n_bytes, spans (array of start and length: maximal removed runs, in order), kept (binary: the
    bytes that remain; they may cut a character). Strings are judged on the input, overlapping ones too, and never cross documents.

    Null text counts as empty, as do texts under `length` bytes: nothing goes. Documents without id come last. Different
    texts of one id are documents of their own, in the order of their SHA-256; of rows that repeat id and text the first
    (nth 1) is as any document, and of the others (nth 2 and on) everything goes. Very long texts are worked in pieces.
    An empty table gives no rows. Columns other than id and text don't matter and aren't returned.
    """
    if length < 17 or length >= 1 << 20:
        raise ValueError("length must be from 17 to 2^20 - 1")
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    most, total = rows.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).agg(F.max("n"), F.sum("size")).first()
    if (most or 0) > 1:
        rows = rows.withColumn("tie", F.sha2("text", 256)).groupBy("id", "tie").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        rows = common.materialize(rows, "repeats-documents")
    else:
        rows = rows.withColumns({"tie": F.lit(""), "copies": F.lit(1).cast("long")})
    kind = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("tie", T.StringType())])
    number = lambda *names: [T.StructField(x, T.LongType()) for x in names]
    found = T.StructType([*kind.fields, *number("bucket", "content", "run")])
    fetched = T.StructType([*kind.fields, *number("bucket", "run"), T.StructField("content", T.BinaryType())])
    gone = T.StructType([*kind.fields, *number("run")])
    arrow = {k: to_arrow_schema(s) for k, s in (("found", found), ("fetched", fetched), ("gone", gone))}

    def located(part: DataFrame) -> DataFrame:
        return part.select("id", "tie", "text").mapInArrow(lambda batches: _located(batches, length, arrow["found"]), found)

    place = [F.col("id").asc_nulls_last(), F.col("tie"), F.col("run")]
    frequent = _frequent(rows, located, total or 0)
    is_kind = lambda k: F.col("run").bitwiseAND(3) == k
    is_frequent = F.col("bucket").isin(frequent) & ~is_kind(_KNOWN) if frequent else F.lit(False)
    bucket = ["bucket", "deal"] if frequent else ["bucket"]  # a constant key would keep the two windows from sharing a shuffle
    dealt = located(rows).withColumns({"frequent": is_frequent, "deal": F.when(is_frequent, F.pmod("content", F.lit(4096))).otherwise(-1)})
    nth = dealt.repartition(*bucket).withColumn("nth", F.row_number().over(Window.partitionBy(*bucket, "content").orderBy(*place)))
    kept = nth.withColumn("firsts", F.sum(F.when(F.col("nth") == 1, 1)).over(Window.partitionBy(*bucket)))
    again = is_kind(_KNOWN) | (F.col("nth") > 1)
    status = F.when(again, 0).when(F.col("frequent") | (F.col("firsts") > WIDE), 2).when(is_kind(_OWN) | (F.col("firsts") > 1), 1)
    judged = common.materialize(kept.select("id", "tie", "bucket", "run", status.cast("byte").alias("status")).where("status is not null"), "repeats-runs")

    open_runs = judged.where("status > 0").groupBy("id", "tie").agg(F.collect_list(F.struct("bucket", "run", (F.col("status") == 2).alias("wide"))).alias("open"))
    texts = rows.alias("d").join(open_runs.alias("o"), F.col("d.id").eqNullSafe(F.col("o.id")) & (F.col("d.tie") == F.col("o.tie"))).select("d.id", "d.tie", "d.text", "o.open")
    content = texts.mapInArrow(lambda batches: _fetched(batches, length, arrow["fetched"]), fetched)
    settled = content.repartition("bucket").sortWithinPartitions("bucket", *place).mapInArrow(lambda batches: _settled(batches, length, arrow["gone"]), gone)
    spans = judged.where("status = 0").select("id", "tie", "run").unionByName(settled).groupBy("id", "tie").agg(F.collect_list("run").alias("runs"))
    spans = common.materialize(spans, "repeats-spans")

    out = T.StructType([kind.fields[0], *number("copies", "n_bytes"), T.StructField("spans", T.ArrayType(T.StructType(number("start", "length")))), T.StructField("kept", T.BinaryType())])
    out_arrow = to_arrow_schema(out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", PIECE):
                texts, spans, kept = common.bytes_of(part, "text"), [], []
                for data, runs in zip(texts, part.column("runs"), strict=True):
                    begins, ends = _merged(runs.values.to_numpy() if runs.is_valid else np.zeros(0, np.int64), length)
                    spans.append([{"start": a, "length": b - a} for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
                    kept.append(b"".join(data[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(data)], strict=True)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("copies"), pa.array([len(x) for x in texts], pa.int64()), pa.array(spans, out_arrow.field("spans").type), pa.array(kept, pa.binary())], schema=out_arrow)
        common.tidy()

    met = rows.alias("d").join(spans.alias("s"), F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.tie") == F.col("s.tie")), "left").select("d.id", "d.text", "d.copies", "s.runs")
    firsts = met.mapInArrow(cut, out)
    if (most or 0) > 1:
        numbered = firsts.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth"))
        whole = (F.col("nth") > 1) & (F.col("n_bytes") >= length)
        every = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("length")))
        firsts = numbered.withColumns({"spans": F.when(whole, every).otherwise(F.col("spans")), "kept": F.when(whole, F.lit(b"")).otherwise(F.col("kept"))})
    else:
        firsts = firsts.withColumn("nth", F.lit(1).cast("long"))
    return firsts.select(F.col("id").alias(id), "nth", "n_bytes", "spans", "kept")


def _merged(runs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal stretches that runs cover."""
    if not len(runs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.sort(runs)
    ends = (begins >> 22) + (begins >> 2 & 0xFFFFF) + length - 1
    begins, ends = begins >> 22, np.maximum.accumulate(ends)
    new = np.ones(len(begins), bool)
    new[1:] = begins[1:] > ends[:-1]
    return begins[new], ends[np.append(np.flatnonzero(new)[1:], len(begins)) - 1]


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier, removed from every whole text of documents."""
    found = repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"), 100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["length"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
