"""URL filtering by a Bloom filter cascade.

The cascade is built over the complete universe of keys that occur in the
corpus: level 1 encodes the listed keys, level 2 the unlisted keys that level 1
lets through, level 3 the listed keys that level 2 lets through, and so on until
none is left. The first level that doesn't hold a key decides, so membership is
exact for every key of the universe and needs no join.

Keys are 128-bit hashes of normalised URLs. The cascade is built in shards by
key hash (each of about SHARD_KEYS keys, so that no task holds more); a shard's
levels are a few bits a listed key. All shards are broadcast where their size,
known once they are written, is below BROADCAST_BYTES; beyond it rows and levels
meet by shard, where the rows stream past the levels, in SALTS tasks a shard.

Defined results: a null URL has a null key and isn't listed; scheme, ``www.``,
user, port, letter case of the host, query, fragment and a trailing ``/`` or
``.html`` don't count (so all pages of a path share its verdict); repeated URLs each
get their verdict; an empty list lists nothing, an empty table gives an empty one;
columns named ``url_key`` or ``blocked`` are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.shared import arrow_map, byte_size, fresh_path, others, quoted, unused

BLOCKED_DOMAINS = ("spam-farm.example.org", "cheap-pills.example.com")
SHARD_KEYS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: Tasks that share a shard's rows where the cascade is too large to broadcast.
SALTS = 16
FIRST_RATE, NEXT_RATE = 0.02, 0.5


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:[wW]{3}\.)?([^/?#:]*)", 1))


def url_key(url: Column) -> Column:
    """host + path, normalised."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    return F.concat(url_host(url), F.regexp_replace(path, r"(?:/|\.html)$", ""))


def domain_listed(host: Column, domains: Sequence[str]) -> Column:
    """The host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return out


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


# -- the cascade in numpy --------------------------------------------------


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, k: int, bits: int) -> np.ndarray:
    """(k, n) bit numbers; levels use unrelated mixes of the two halves."""
    with np.errstate(over="ignore"):
        salt = np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        a = (h1 ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
        b = (h2 + salt) * np.uint64(0x94D049BB133111EB)
        a, b = a ^ (a >> np.uint64(29)), (b ^ (b >> np.uint64(31))) | np.uint64(1)
        return np.stack([((a + np.uint64(i) * b) >> np.uint64(11)) % np.uint64(bits) for i in range(k)])


def _inside(filt: np.ndarray, bits: int, k: int, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out = np.ones(len(h1), bool)
    for p in _positions(h1, h2, level, k, bits):
        out &= (filt[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def build_cascade(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> bytes:
    """Levels of one shard: each (bits uint64, k uint64, bytes)."""
    now, against, parts, level = np.flatnonzero(listed), np.flatnonzero(~listed), [], 0
    while len(now):
        rate = FIRST_RATE if level == 0 else NEXT_RATE
        bits = max(64, int(np.ceil(-len(now) * np.log(rate) / np.log(2) ** 2)) + 7 & ~7)
        k = max(1, round(-np.log2(rate)))
        filt = np.zeros(bits // 8, np.uint8)
        pos = _positions(h1[now], h2[now], level, k, bits).ravel()
        np.bitwise_or.at(filt, (pos >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (pos & np.uint64(7)).astype(np.uint8)))
        parts.append(np.array([bits, k], np.uint64).tobytes() + filt.tobytes())
        hit = _inside(filt, bits, k, level, h1[against], h2[against])
        now, against, level = against[hit], now, level + 1
        if level > 200:
            raise ValueError("two different keys have the same 128-bit hash")
    return b"".join(parts)


def query_cascade(blob: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out, at, level = np.zeros(len(h1), bool), 0, 0
    live = np.arange(len(h1))
    while at < len(blob) and len(live):
        bits, k = (int(x) for x in np.frombuffer(blob, np.uint64, 2, at))
        filt = np.frombuffer(blob, np.uint8, bits // 8, at + 16)
        live = live[_inside(filt, bits, k, level, h1[live], h2[live])]
        out[live] = level % 2 == 0  # held by an odd number of levels so far: listed
        at, level = at + 16 + bits // 8, level + 1
    return out


# -- on Spark ---------------------------------------------------------------


def build(universe: DataFrame, key_col: str, listed_col: str, shard_keys: int = SHARD_KEYS) -> tuple[str, int]:
    """Writes the shards (shard, levels) of the cascade; returns the path and the number of shards.

    ``universe`` may repeat keys; a key is listed if any of its rows says so.
    Only hashes are shuffled.
    """
    spark = universe.sparkSession
    h1, h2 = _hashes(F.col(quoted(key_col)))
    keys = universe.filter(F.col(quoted(key_col)).isNotNull()).select(h1.alias("h1"), h2.alias("h2"), F.coalesce(F.col(quoted(listed_col)), F.lit(False)).alias("listed"))
    shards = max(1, -(-int(keys.agg(F.approx_count_distinct("h1")).first()[0]) // shard_keys))

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.groupby(["h1", "h2"], as_index=False)["listed"].max()
        blob = build_cascade(pdf["h1"].to_numpy(np.int64).view(np.uint64), pdf["h2"].to_numpy(np.int64).view(np.uint64), pdf["listed"].to_numpy(bool))
        return pd.DataFrame({"shard": [key[0]], "levels": [blob]})

    path = fresh_path(spark, "url-cascade")
    distinct = keys.groupBy("h1", "h2").agg(F.max("listed").alias("listed"))
    distinct.groupBy(F.pmod("h2", F.lit(shards)).cast("int").alias("shard")).applyInPandas(one, "shard int, levels binary").write.parquet(path)
    return path, shards


def probe(df: DataFrame, key_col: str, cascade: str, shards: int, out_col: str = "blocked", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All rows and columns of ``df`` with the verdict; false for a null key."""
    spark = df.sparkSession
    h1, h2 = _hashes(F.col(quoted(key_col)))
    rest = others(df.columns, ["__h1", "__h2", "__shard", "__known", out_col])
    keyed = df.select(*[F.col(quoted(c)) for c in rest], h1.alias("__h1"), h2.alias("__h2"), F.col(quoted(key_col)).isNotNull().alias("__known"))
    levels = spark.read.schema("shard int, levels binary").parquet(cascade)
    if byte_size(spark, cascade) <= broadcast_bytes:
        held = spark.sparkContext.broadcast({r.shard: bytes(r.levels) for r in levels.toLocalIterator()})

        def make():
            blobs = held.value

            def batch(b: pa.RecordBatch) -> list[pa.Array]:
                a, c = (np.asarray(b.column(i)).view(np.uint64) for i in (0, 1))
                shard = np.asarray(b.column(1)) % shards
                out = np.zeros(b.num_rows, bool)
                for s in np.unique(shard):
                    at = np.flatnonzero(shard == s)
                    out[at] = query_cascade(blobs.get(int(s), b""), a[at], c[at])
                return [pa.array(out & np.asarray(b.column(2)))]

            return batch

        return arrow_map(keyed, ["__h1", "__h2", "__known"], rest, [T.StructField(out_col, T.BooleanType())], make)

    # the levels travel to the rows of their shard and come first there; the rows stream past them
    shard, salt, order, blob = (unused(keyed.columns, c) for c in ("__shard", "__salt", "__order", "__levels"))
    rows = keyed.withColumns({shard: F.pmod("__h2", F.lit(shards)).cast("int"), salt: F.pmod(F.xxhash64(*[F.col(quoted(c)).cast("string") for c in rest] or [F.lit(0)]), F.lit(SALTS)).cast("int"), order: F.lit(1), blob: F.lit(None).cast("binary")})
    copies = levels.select(F.col("shard").alias(shard), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt), F.lit(0).alias(order), F.col("levels").alias(blob))
    both = rows.unionByName(copies, allowMissingColumns=True).select(*[F.col(quoted(c)) for c in rest], "__h1", "__h2", "__known", shard, salt, order, blob)
    both = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), shard, salt).sortWithinPartitions(shard, salt, order)
    schema = T.StructType([*(rows.schema[c] for c in rest), T.StructField(out_col, T.BooleanType())])
    k = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, b""
        for b in batches:
            where = np.asarray(b.column(k + 3)).astype(np.int64) * SALTS + np.asarray(b.column(k + 4))
            first = np.asarray(b.column(k + 5)) == 0
            cuts = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (first[1:] != first[:-1])])) if b.num_rows else []
            for i, j in zip(cuts, [*cuts[1:], b.num_rows]):
                if first[i]:
                    now, held = where[i], b.column(k + 6)[int(i)].as_py()
                    continue
                part = b.slice(int(i), int(j - i))
                a, c = (np.asarray(part.column(k + n)).view(np.uint64) for n in (0, 1))
                out = query_cascade(held if now == where[i] else b"", a, c) & np.asarray(part.column(k + 2))
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(out)], schema.fieldNames())

    return both.mapInArrow(run, schema)


def filter_urls(pages: DataFrame, url_col: str = "url", domains: Sequence[str] = BLOCKED_DOMAINS, listed: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``pages`` with ``url_key`` and ``blocked``.

    ``listed``: a table whose first column holds listed URLs. Without it the
    list is every URL of the corpus on a blocked domain or below one. Listed
    URLs that the corpus doesn't have join the universe, which harms nothing.
    """
    src = pages.select(*[F.col(quoted(c)) for c in others(pages.columns, ["url_key", "blocked"])])
    keyed = src.withColumn("url_key", url_key(F.col(quoted(url_col))))
    if listed is None:
        universe = keyed.select("url_key", domain_listed(url_host(F.col(quoted(url_col))), domains).alias("listed"))
    else:
        universe = keyed.select("url_key", F.lit(False).alias("listed")).unionAll(listed.select(url_key(F.col(quoted(listed.columns[0]))).alias("url_key"), F.lit(True).alias("listed")))
    path, shards = build(universe, "url_key", "listed", shard_keys)
    return probe(keyed, "url_key", path, shards, "blocked", broadcast_bytes)


def oracle(domains: Sequence[str] = BLOCKED_DOMAINS) -> str:
    host = r"lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:[wW]{3}\.)?([^/?#:]*)', 1))"
    path = r"regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '(?:/|\.html)$', '')"
    rule = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in domains)
    return f"""SELECT page_id, url, key AS url_key, bool_or({rule}) OVER (PARTITION BY key) AS blocked
FROM (SELECT page_id, url, {host} AS host, {host} || {path} AS key FROM pages)"""
