"""Vector code compression: parts of integer vectors to codebook entries, by per-dimension value dictionaries."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomart.runtime import cut_lineage, measured

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
# Integers stop here, so that errors fit a long; no component between -65,536 and 65,536 is changed.
MOST = 1 << 26
BLOCK_CELLS = 1 << 19  # components of a block, whose dictionaries hold no more values
STRIPE = 512  # rows whose distances are in hand at once

Codebooks = np.ndarray  # (part, entry, place within the part)


def quantised(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """``vectors`` (vec_id, vector, label) to (vec_id, label, q array<int>), the integers floor(scale * x).

    Rows whose vector is null, or holds null or non-finite components, go. So do empty vectors and those of another length than most
    (ties: the longer), which no codebook fits; if that length is no multiple of ``parts``, all go.
    """
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(F.coalesce((F.size("vector") > 0) & fine, F.lit(False)))
    lengths = usable.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    length = lengths["d"] if lengths and lengths["d"] % parts == 0 else -1
    whole = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int")
    return usable.where(F.size("vector") == length).select("vec_id", "label", F.transform("vector", whole).alias("q"))


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the vectors of the smallest vec_ids, ascending; nulls last, ties by the vector. At most ``entries`` rows come here."""
    rows = vectors.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).select("q").collect()
    width = len(rows[0]["q"]) // parts if rows else 0
    return np.array([r["q"] for r in rows], dtype=np.int64).reshape(len(rows), parts, width).transpose(1, 0, 2)


def dictionary(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of one dimension, ascending, and the code of every value among them."""
    low, high = int(values.min()), int(values.max())
    if high - low > 8 * len(values):
        known, codes = np.unique(values, return_inverse=True)
        return known.astype(np.int64), codes
    here = np.zeros(high - low + 1, dtype=bool)
    here[values - low] = True
    return np.flatnonzero(here) + low, (np.cumsum(here) - 1)[values - low]


def nearest(block: np.ndarray, codebooks: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Entry of every part of every row, and its squared distance: two arrays (part, row). Ties go to the lower entry.

    The squared differences of each distinct integer of a dimension to all entries are tabulated once; the distances of a row are
    the table rows of its dictionary codes, added up.
    """
    parts, entries, width = codebooks.shape
    codes = np.empty((parts, len(block)), dtype=np.int64)
    errors = np.empty((parts, len(block)), dtype=np.int64)
    reach = max(int(abs(block).max()), int(abs(codebooks).max())) * 2
    kind = np.int32 if reach * reach * width < 1 << 31 else np.int64
    for part in range(parts):
        tables, places = [], []
        for i in range(width):
            known, code = dictionary(block[:, part * width + i])
            tables.append(np.square(known[:, None] - codebooks[part, :, i]).astype(kind))
            places.append(code)
        for a in range(0, len(block), STRIPE):
            b = min(a + STRIPE, len(block))
            total = tables[0][places[0][a:b]]
            for table, place in zip(tables[1:], places[1:], strict=True):
                total += table[place[a:b]]
            best = total.argmin(axis=1)
            codes[part, a:b] = best
            errors[part, a:b] = total[np.arange(b - a), best]
    return codes, errors


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors as a matrix of bounded size."""
    for batch in batches:
        if batch.num_rows:
            q = batch.column("q")
            width = len(q.flatten()) // batch.num_rows
            step = max(1, BLOCK_CELLS // width)
            for a in range(0, batch.num_rows, step):
                piece = batch.slice(a, step)
                yield piece, piece.column("q").flatten().to_numpy().astype(np.int64).reshape(-1, width)


def moved(vectors: DataFrame, codebooks: Codebooks) -> Codebooks:
    """Every entry replaced by the componentwise floored mean of the parts nearest to it; unused entries stay.

    A task adds up its parts per entry, so one row per (part, entry) and task is shuffled, whatever the input.
    """
    told = vectors.sparkSession.sparkContext.broadcast(codebooks)
    parts, entries, width = codebooks.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = told.value
        counts = np.zeros((parts, entries), dtype=np.int64)
        sums = np.zeros((parts, entries, width), dtype=np.int64)
        for _, block in _blocks(batches):
            codes, _ = nearest(block, books)
            for part in range(parts):
                counts[part] += np.bincount(codes[part], minlength=entries)
                for i in range(width):
                    # exact: a block's sums are far below 2**53
                    sums[part, :, i] += np.bincount(codes[part], weights=block[:, part * width + i], minlength=entries).astype(np.int64)
        part, entry = np.nonzero(counts)
        columns = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    partial = vectors.select("q").mapInArrow(add, "part int, entry int, n long, sums array<long>")
    totals = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    out = codebooks.copy()
    # parts * entries rows
    for row in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():
        out[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return out


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of the stored ``vectors`` of ``quantised``, after ``rounds`` passes over all of them."""
    books = first_codebooks(vectors, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = moved(vectors, books)
    return books


def assign(vectors: DataFrame, codebooks: Codebooks) -> DataFrame:
    """``vectors`` of ``quantised`` to (vec_id, label, codes array<int>, error): each part's nearest entry, and the squared distances' sum."""
    told = vectors.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in _blocks(batches):
            codes, errors = nearest(block, told.value)
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(list(codes.T.astype(np.int32)), pa.list_(pa.int32())), pa.array(errors.sum(axis=0))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "codes", "error"])

    kinds = [f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("vec_id", "label")]
    return vectors.mapInArrow(run, f"{', '.join(kinds)}, codes array<int>, error long")


def restored(codes: DataFrame, codebooks: Codebooks, scale: int = SCALE) -> DataFrame:
    """``codes`` with ``vector``, the entries' integers over ``scale``: what the code keeps of the vector."""
    books = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in entry]) for entry in part]) for part in codebooks])
    parts = F.transform("codes", lambda code, i: F.get(F.get(books, i), code))
    return codes.withColumn("vector", F.transform(F.flatten(parts), lambda x: x / scale))


def codebooks_digest(codebooks: Codebooks) -> str:
    return sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """Codes of all usable ``vectors`` (vec_id, vector, label; other columns are left out), and the codebooks.

    Repeated rows count as often as they occur. Fewer usable vectors than entries give as many entries; none give no rows.
    """
    stored = cut_lineage(quantised(vectors, parts))
    books = fit(stored, parts, entries, rounds)
    return assign(stored, books), books


def digests(codes: DataFrame, codebooks: Codebooks) -> DataFrame:
    """Codes as text, with each label's summed error and the digest of the codebooks.

    The sum of a label that does not fit a long is null.
    """
    codes = cut_lineage(codes)
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    by_label = cut_lineage(codes.groupBy("label").agg(total.alias("label_error")))
    told = measured(by_label, by_label.count())
    joined = codes.alias("c").join(told.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    text = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return joined.select("vec_id", text.alias("code"), "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))


def oracle(width: int = 16) -> str:
    """DuckDB SQL: rounds unrolled, distances by inner products, which are exact in doubles here."""
    parts = " union all ".join(f"select vec_id, label, {p} as part, q[{p * width + 1}:{(p + 1) * width}] as v from q" for p in range(PARTS))
    steps = [
        f"""q as materialized (select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized ({parts}),
b0 as materialized (select part, rank - 1 as entry, v from (select part, v, row_number() over (partition by part order by vec_id) as rank from p) x where rank <= {ENTRIES})"""
    ]
    for i in range(ROUNDS + 1):
        near = f"""a{i} as materialized (select vec_id, label, part, v, arg_min(entry, d * {ENTRIES} + entry) as entry, min(d) as d from (select p.vec_id, p.label, p.part, p.v, b.entry,
  list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v) as d from p join b{i} b on b.part = p.part) x group by vec_id, label, part, v)"""
        steps.append(near)
        if i < ROUNDS:
            sums = ", ".join(f"floor(sum(v[{j}]) / count(*))" for j in range(1, width + 1))
            steps.append(
                f"m{i} as (select part, entry, [{sums}] as v from a{i} group by part, entry),\n"
                f"b{i + 1} as materialized (select b.part, b.entry, coalesce(m.v, b.v) as v from b{i} b left join m{i} m on m.part = b.part and m.entry = b.entry)"
            )
    return f"""with {", ".join(steps)},
r as (select vec_id, label, string_agg(lower(printf('%02x', entry::int)), '' order by part) as code, sum(d)::bigint as error from a{ROUNDS} group by vec_id, label),
s as (select sha256(string_agg(array_to_string(list_transform(v, lambda x: x::bigint), ','), ',' order by part, entry)) as digest from b{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, digest as codebooks_sha256 from r cross join s"""
