"""Registered queries of the digest operators, and the same in SQL where it can say them.

Objects are the texts of the tables as UTF-8 bytes. Where a query needs features
but not the kernel, a text's own SHA-1 is its one feature.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import tables as t
from ..operators import compare, digest, filters, ground_truth, index, segments
from ..sources import digest_text, files, index_file, large_file
from ..sources import segments as segment_source
from ..operators.storage import shared_folder
from ..streaming import ingest
from . import catalog

#: Sizes scaled to the tables' texts.
LIMIT, SEGMENT, BLOCK, BATCH = 4096, 2048, 1024, 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.from_texts(table(spark, sf_dir, "documents"), "doc_id", "text", "doc-")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.from_texts(table(spark, sf_dir, "pages"), "page_id", "html", "page-")


def _text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.sha1(c.content(F.col("text"))).alias("sha1"))


def eligible_objects(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    every = documents(spark, sf_dir).unionByName(pages(spark, sf_dir)).unionByName(files.from_texts(conversations, "id", "text", "turn-"))
    return every.where(c.eligible(F.col("content"))).select("name", "size")


def size_router(spark, sf_dir):
    size = F.col("size")
    return documents(spark, sf_dir).select("name", "size", c.size_class(size, LIMIT).alias("size_class"), c.block_kib(size, -1, LIMIT).alias("block_kib"), c.block_kib(size, 4, LIMIT).alias("asked_kib"))


def segment_plan(spark, sf_dir):
    return segments.plan_segments(documents(spark, sf_dir), segment=SEGMENT)


def block_plan(spark, sf_dir):
    return segments.plan_blocks(documents(spark, sf_dir), block=BLOCK)


def batch_plan(spark, sf_dir):
    return segments.plan_batches(documents(spark, sf_dir), limit=BATCH)


def feature_bits(spark, sf_dir):
    rows = _text_features(spark, sf_dir).select("doc_id", c.feature_bits(F.col("sha1")).alias("small"), c.feature_bits(F.col("sha1"), t.LARGE_MASK).alias("large"))
    return rows.select("doc_id", F.posexplode(F.arrays_zip("small", "large")).alias("word", "bits")).select("doc_id", "word", F.col("bits.small").alias("small_bit"), F.col("bits.large").alias("large_bit"))


def bloom_build(spark, sf_dir):
    built = filters.build_filters(_text_features(spark, sf_dir), "source")
    return built.select("grp", "elements", c.hamming(F.col("words")).cast("int").alias("hamming"), F.round(c.bits_per_element(F.lit(t.SMALL_BYTES), F.col("elements")), 6).alias("bits_per_element"))


def bloom_bits(spark, sf_dir):
    return filters.bits_of(_text_features(spark, sf_dir), "source")


def bloom_union(spark, sf_dir):
    built = filters.build_filters(_text_features(spark, sf_dir), "source")
    a = built.select(F.col("grp").alias("a"), F.col("words").alias("x"))
    b = built.select(F.col("grp").alias("b"), F.col("words").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", c.hamming(c.union(F.col("x"), F.col("y"))).cast("int").alias("hamming"))


def bloom_fold(spark, sf_dir):
    built = filters.build_filters(_text_features(spark, sf_dir), "source")
    return built.select("grp", c.hamming(c.fast(F.col("words"))).cast("int").alias("fast_hamming"))


def large_fold(spark, sf_dir):
    built = filters.build_filters(_text_features(spark, sf_dir), "lang", size=t.LARGE_BYTES)
    words = F.col("words")
    return built.select("grp", c.hamming(words).cast("int").alias("hamming"), c.hamming(c.fold(words, t.LARGE_BYTES // 8, 3)).cast("int").alias("folded"))


def _filter_pairs(spark, sf_dir):
    built = filters.build_filters(_text_features(spark, sf_dir), "source")
    a = built.select(F.col("grp").alias("a"), F.col("elements").alias("s1"), F.col("words").alias("x"))
    b = built.select(F.col("grp").alias("b"), F.col("elements").alias("s2"), F.col("words").alias("y"))
    return a.join(b, F.col("a") < F.col("b"))


def filter_overlap(spark, sf_dir):
    estimate = c.match_estimate(2048, 5, F.col("s1"), F.col("s2"), F.lit(0))
    return _filter_pairs(spark, sf_dir).select("a", "b", c.overlap(F.col("x"), F.col("y")).cast("int").alias("overlap"), estimate.alias("estimate"))


def filter_score(spark, sf_dir):
    x, y, s1, s2 = (F.col(n) for n in ("x", "y", "s1", "s2"))
    return _filter_pairs(spark, sf_dir).select("a", "b", c.cutoff(s1, s2).alias("cutoff"), F.round(c.filter_score(x, s1, y, s2), 6).alias("score"))


def score_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("query"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("target"), (F.col("doc_id") % 102 - 1).alias("score"))
    return compare.comparison_lines(rows, "csv")


def window_entropy(spark, sf_dir):
    return digest.window_statistics(documents(spark, sf_dir))


def chunk_ranks(spark, sf_dir):
    return digest.rank_histogram(documents(spark, sf_dir))


def popularity_scores(spark, sf_dir):
    return digest.popularity_histogram(documents(spark, sf_dir))


def stream_features(spark, sf_dir):
    return digest.features(documents(spark, sf_dir)).withColumn("sha1", F.lower(F.hex("sha1")))


def stream_digest(spark, sf_dir):
    return digest.digest(documents(spark, sf_dir))


def block_digest(spark, sf_dir):
    return digest.digest(documents(spark, sf_dir), block_size=BLOCK)


def sized_digest(spark, sf_dir):
    return digest.digest_by_size(documents(spark, sf_dir), limit=LIMIT)


def segment_digest(spark, sf_dir):
    return digest.digest(segments.cut_segments(documents(spark, sf_dir), segment=SEGMENT))


def _numbered(spark, sf_dir):
    return stream_digest(spark, sf_dir).withColumn("digest_id", F.substring("name", 5, 20).cast("long"))


def compare_all(spark, sf_dir):
    return compare.compare_all(_numbered(spark, sf_dir))


def compare_fast(spark, sf_dir):
    return compare.compare_all(_numbered(spark, sf_dir), fast=True)


def compare_to(spark, sf_dir):
    return compare.compare_to(digest.digest(pages(spark, sf_dir)), stream_digest(spark, sf_dir))


def compare_sampled(spark, sf_dir):
    return compare.compare_to(digest.digest(pages(spark, sf_dir)), stream_digest(spark, sf_dir), sample=1)


def compare_matrix(spark, sf_dir):
    return compare.compare_matrix(digest.digest(pages(spark, sf_dir)), stream_digest(spark, sf_dir))


def compare_blocks(spark, sf_dir):
    blocks = block_digest(spark, sf_dir)
    return compare.compare_to(blocks, stream_digest(spark, sf_dir), threshold=10)


def digest_text_roundtrip(spark, sf_dir):
    lines = block_digest(spark, sf_dir).unionByName(stream_digest(spark, sf_dir)).select(digest_text.digest_line().alias("value"))
    return digest_text.parse_digests(lines).select("name", "mode", "input_size", "bf_count", "last_count", digest_text.digest_line().alias("line"))


def validate(spark, sf_dir):
    return digest_text.validate(stream_digest(spark, sf_dir).select(digest_text.digest_line().alias("value")))


def _index_features(spark, sf_dir):
    return _text_features(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("offset"), F.unhex("sha1").alias("sha1"), "lang", "source")


#: A mask of few bits, so that features collide, and a set for each seven documents.
_NARROW = (1 << 12) - 1


def _page() -> Column:
    return F.lpad(F.floor(F.col("name").cast("long") / 7).cast("string"), 9, "0")


def index_build(spark, sf_dir):
    built = index.build_index(_index_features(spark, sf_dir), "source")
    return built.select("index_set", "bucket", F.bitmap_count("bitmap").alias("bits"))


def index_merge(spark, sf_dir):
    built = index.build_index(_index_features(spark, sf_dir), "source")
    merged = index.merge_indexes(built.select(F.lit("all").alias("index_set"), "bucket", "bitmap"))
    return merged.select("index_set", "bucket", F.bitmap_count("bitmap").alias("bits"))


def index_probe(spark, sf_dir):
    rows = _index_features(spark, sf_dir)
    return index.probe_index(rows, index.build_index(rows, "source")).select("name", "index_set")


def index_elements(spark, sf_dir):
    """What indexes in a filter so small that many features set no new bit count."""
    return index.counted_elements(_index_features(spark, sf_dir), "lang", mask=_NARROW)


def index_slices(spark, sf_dir):
    """Indexes of pages of documents, side by side: how many of them have each bit."""
    sliced = index.build_sliced(_index_features(spark, sf_dir), _page(), mask=_NARROW, words=2)
    weights = [F.bit_count(w) for w in sliced.words]
    return sliced.bits.select("bit", "part", *(F.col(w) for w in sliced.words), sum(weights[1:], weights[0]).cast("int").alias("sets"))


def sliced_probe(spark, sf_dir):
    """Features of all documents in the indexes of pages of them."""
    rows = _index_features(spark, sf_dir)
    return index.build_sliced(rows, _page(), mask=_NARROW, words=2).probe(rows).select("name", "index_set")


def index_search(spark, sf_dir):
    docs = documents(spark, sf_dir)
    known = index.in_batches(digest.features(docs, block_size=16 << 10), docs, "documents", limit=256 * BATCH)
    # bits as rows: a bitmap of 4 KB for each 32,768 bits of each batch would be zeros nearly throughout
    return index.build_sliced(known, "index_set", words=1).search(digest.features(pages(spark, sf_dir), block_size=16 << 10))


def index_files(spark, sf_dir):
    built = index.build_index(_index_features(spark, sf_dir), "lang", mask=(1 << 20) - 1)
    return index_file.export_index(built, size=1 << 17).select("index_set", F.octet_length("file").alias("bytes"), F.md5("file").alias("md5"))


def large_digests(spark, sf_dir):
    return digest.large_digest(documents(spark, sf_dir)).select("name", "file_size", "filter_count", F.element_at("filters", -1)["elem_count"].alias("last_elements"))


def _volumes(spark, sf_dir, n: int) -> DataFrame:
    """Each n documents with neighbouring ids as one object."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").groupBy(F.floor(F.col("doc_id") / n).alias("k"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
    return docs.agg(c.content(F.array_join(texts, "\n")).alias("content")).select(F.concat(F.lit(f"{n}-"), F.col("k").cast("string")).alias("name"), "content")


def large_compare(spark, sf_dir):
    """Volumes of 32 documents against volumes of 64."""
    return compare.compare_large(*(digest.large_digest(_volumes(spark, sf_dir, n)) for n in (32, 64)))


def large_roundtrip(spark, sf_dir):
    made = large_file.export_large(digest.large_digest(pages(spark, sf_dir)))
    return large_file.large_details(large_file.parse_large(made.withColumnRenamed("file", "content")))


def _sets(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.octet_length(c.content(F.col("text"))).cast("long").alias("input_size"), F.lit(1).cast("long").alias("bf_count"))
    return catalog.set_summary(rows, "source")


def set_summary(spark, sf_dir):
    return _sets(spark, sf_dir)


def set_listing_json(spark, sf_dir):
    return catalog.listing_json(_sets(spark, sf_dir).withColumn("set_id", F.substring("set_name", 4, 9)))


def result_status(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("lines"))
    started = F.timestamp_seconds(F.col("conv_id") * 60)
    ended = F.when(F.col("lines") % 3 != 0, F.timestamp_seconds(F.col("conv_id") * 60 + F.col("lines")))
    now = F.timestamp_seconds(F.col("conv_id") * 60 + 1000)
    return turns.select("conv_id", catalog.job_status(started, ended, F.col("lines")).alias("status"), catalog.job_duration(started, ended, now).alias("duration"))


def common_substrings(spark, sf_dir):
    """Neighbouring turns of conversations."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode("text", "utf-8").alias("x"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    return turns.join(following, ["conv_id", "turn"]).select("conv_id", "turn", F.round(ground_truth.common_ratio(F.col("x"), F.col("y")), 6).alias("ratio"))


def stream_ingest(spark, sf_dir):
    """Documents as a stream of rows, digested and kept."""
    source = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parquet*")
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    objects = files.from_texts(source, "doc_id", "text", "doc-")
    ingest.append_digests(ingest.digest_stream(objects), f"{folder}/digests", f"{folder}/log").awaitTermination()
    return spark.read.parquet(f"{folder}/digests")


def stream_segments(spark, sf_dir):
    """The files of the tables as a stream of segments."""
    source = segment_source.stream_segments(spark, sf_dir, segment=1 << 17, recursive=True, settle_seconds=0)
    folder = f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}"
    rows = source.select(F.element_at(F.split("name", "/"), -1).alias("name"), "start", F.octet_length("content").alias("length"), F.md5("content").alias("md5"))
    rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def stream_distinct(spark, sf_dir):
    """Documents as a stream, one a second, without digests that have come before: how many different ones of each size."""
    source = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parquet*")
    folder = f"{shared_folder(spark)}/distinct-{uuid.uuid4().hex}"
    objects = files.from_texts(source, "doc_id", "text", "doc-")
    digests = digest.digest(objects).withColumn("at", F.timestamp_seconds(86400 + F.substring("name", 5, 20).cast("long")))
    rows = ingest.first_digests(digests, "at", delay="100 years").select("input_size")
    rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows").groupBy("input_size").agg(F.count("*").alias("digests"))


_BYTE = "((instr('0123456789abcdef', substr(h, {0}, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, {1}, 1)) - 1)"


def _word_sql(w: str) -> str:
    parts = [_BYTE.format(f"8 * {w} + {2 * i + 1}", f"8 * {w} + {2 * i + 2}") + f" * {256**i}" for i in range(4)]
    return "CAST(" + " + ".join(f"CAST({p} AS BIGINT)" for p in parts) + " AS BIGINT)"


_WORDS = f"feature AS (SELECT doc_id, lang, source, sha1(text) AS h FROM documents), word AS (SELECT doc_id, lang, source, h, w, {_word_sql('w')} AS v FROM feature, (SELECT unnest(range(0, 5)) AS w))"
_SOURCE = "e AS (SELECT source AS grp, count(DISTINCT h) AS n FROM feature GROUP BY source), b AS (SELECT DISTINCT source AS grp, v % 2048 AS bit FROM word)"
_PAIRS = (
    _SOURCE + ", h AS (SELECT grp, count(*) AS h FROM b GROUP BY grp), "
    "p AS (SELECT x.grp AS a, y.grp AS b, x.n AS s1, y.n AS s2, hx.h AS h1, hy.h AS h2 FROM e x JOIN e y ON x.grp < y.grp JOIN h hx ON hx.grp = x.grp JOIN h hy ON hy.grp = y.grp), "
    "m AS (SELECT x.grp AS a, y.grp AS b, count(*) AS m, count(*) FILTER (x.bit < 256) AS m4, count(*) FILTER (x.bit < 512) AS m8, count(*) FILTER (x.bit < 1024) AS m16 FROM b x JOIN b y ON x.bit = y.bit AND x.grp < y.grp GROUP BY ALL), "
    "q AS (SELECT p.*, coalesce(m, 0) AS m, coalesce(m4, 0) AS m4, coalesce(m8, 0) AS m8, coalesce(m16, 0) AS m16 FROM p LEFT JOIN m USING (a, b))"
)
_SIZE = "octet_length(encode(text))"
_HUMAN = "CASE WHEN s > 1073741824 THEN (s // 1073741824) || 'G' WHEN s > 1048576 THEN (s // 1048576) || 'M' ELSE (s // 1024) || 'K' END"
_SUMMARY = f"SELECT source AS set_name, count(*) AS items, CAST(count(*) AS BIGINT) AS filters, CAST(sum({_SIZE}) AS BIGINT) AS s FROM documents GROUP BY source"


_DOCUMENTS = f"SELECT row_number() OVER () AS r, 'doc-' || doc_id AS name, encode(text) AS x FROM documents WHERE {_SIZE} >= 512"
_PAGES = "SELECT 1000000000 + row_number() OVER () AS r, 'page-' || page_id AS name, encode(html) AS x FROM pages WHERE octet_length(encode(html)) >= 512"


def _entropy_sql(objects: str = _DOCUMENTS) -> str:
    """Entropy classes of all windows but the last: how often a byte stands in the 63 places before or behind it gives what it adds and takes."""
    units = t.entropy_units()
    step = "[" + ", ".join(str(int(x)) for x in units[1:] - units[:-1]) + "]"
    return f"""o AS MATERIALIZED ({objects}),
            h AS (SELECT r, name, x, unnest(range(0, octet_length(x))) AS p FROM o),
            b AS (SELECT r, name, p, x[p + 1 : p + 1] AS c FROM h),
            n AS (SELECT r, name, p,
                {step}[count(*) OVER (PARTITION BY r, c ORDER BY p RANGE BETWEEN 63 PRECEDING AND 1 PRECEDING) + 1] AS more,
                {step}[count(*) OVER (PARTITION BY r, c ORDER BY p RANGE BETWEEN 1 FOLLOWING AND 63 FOLLOWING) + 1] AS less FROM b),
            e AS (SELECT r, name, p, sum(more) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 63 FOLLOWING)
                - coalesce(sum(less) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u,
                count(*) OVER (PARTITION BY r) AS size FROM n),
            w AS (SELECT r, name, CAST(u // 1024 AS INT) AS entropy FROM e WHERE p < size - 64)"""


#: Doublings of the way through elections that SQL follows: 2 ** 20 elections in an object.
_ROUNDS = 20


def _votes_sql(objects: str = _DOCUMENTS) -> str:
    """Votes for the places of all objects, as `votes` (r, p, score), beside ranks `k` (r, name, p, size, rank).

    What each window leads to, as an election (twice its offset) or a takeover (one more),
    is a row of its own. Which of these rows happen is found by doubling: those that 1, 2, 4, ... steps lead to from
    the first election on.
    """
    ranks = "[" + ", ".join(map(str, t.default_ranks().tolist())) + "]"
    lead = ", ".join(f"lead(rank, {d}, 0) OVER o AS l{d}" for d in range(1, 127))

    def ahead(first: int, end: int, low: str) -> str:
        return "CASE " + " ".join(f"WHEN l{d} <= {low} THEN {2 * d} + CAST(l{d} = {low} AS INT)" for d in range(first, end)) + f" ELSE {2 * end} END"

    out = f"""{_entropy_sql(objects)},
            k AS MATERIALIZED (SELECT r, name, p, size, CAST(CASE WHEN p < size - 64 THEN {ranks}[CAST(u // 1024 AS INT) + 1] ELSE 0 END AS INT) AS rank FROM e),
            -- the leftmost smallest positive rank of each window, the last place of each run of equals, the next place that has a rank, the ranks that come
            v AS (SELECT r, p, size, rank,
                min(CASE WHEN rank > 0 THEN CAST(rank AS BIGINT) * 4294967296 + p END) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING) AS least,
                min(CASE WHEN change THEN p END) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS run,
                coalesce(min(CASE WHEN rank > 0 THEN p END) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), size) AS waits, {lead}
                FROM (SELECT *, rank IS DISTINCT FROM lead(rank) OVER (PARTITION BY r ORDER BY p) AS change FROM k) WINDOW o AS (PARTITION BY r ORDER BY p)),
            -- twice the distance of the first rank that isn't greater, behind the window and one more or behind the place itself, and one more if it is equal
            a AS MATERIALIZED (SELECT r, p, size, rank, least % 4294967296 AS at, run, waits, {ahead(65, 127, "(least // 4294967296)")} AS far, {ahead(1, 64, "rank")} AS near FROM v),
            c AS (SELECT a.r, 2 * a.p AS state, least(x.run, a.p + 63) AS place, a.p + a.far // 2 - 64 AS stop, a.far % 2 AS same, a.p
                    FROM a JOIN a x ON a.r = x.r AND x.p = a.at WHERE a.rank > 0 AND a.p < a.size - 64
                  UNION ALL SELECT r, 2 * p - 127, p, p + near // 2 - 64, near % 2, p - 64 FROM a WHERE rank > 0 AND p >= 64),
            d AS (SELECT r, state, place, p, greatest(least(stop, place), p + 1) AS stop, stop < place AND same = 1 AS over FROM c),
            -- the windows up to the end vote for the place; then it is taken over, or there is an election
            s AS MATERIALIZED (SELECT d.r, state, place, stop - d.p AS n, CASE WHEN over THEN 2 * stop + 1 ELSE 2 * w.waits END AS following
                FROM d JOIN a w ON w.r = d.r AND w.p = stop),
            r0 AS (SELECT r, 2 * waits AS state FROM a WHERE p = 0),
            j0 AS MATERIALIZED (SELECT r, state, following FROM s WHERE (r, state) IN (SELECT r, following FROM s UNION ALL FROM r0))"""
    for i in range(_ROUNDS):
        out += f""",
            r{i + 1} AS MATERIALIZED (SELECT r, state FROM r{i} UNION SELECT r, following FROM r{i} JOIN j{i} USING (r, state)),
            j{i + 1} AS MATERIALIZED (SELECT x.r, x.state, y.following FROM j{i} x JOIN j{i} y ON x.r = y.r AND x.following = y.state)"""
    return f"""{out},
            votes AS MATERIALIZED (SELECT r, place AS p, CAST(sum(n) AS INT) AS score FROM s JOIN r{_ROUNDS} USING (r, state) GROUP BY r, place)"""


def _digest_sql(objects: str) -> str:
    """Stream digests: filters `flt` (r, k, n elements, weight), their bits `bit` (r, k, b), and `dg` (r, name, size, nf filters, total elements).

    In a filter, a feature passes if it is the first one with one of its bits; it counts if
    it is also the first of all that passed with one of its bits in the large filter. With
    160 that count a filter is full and the next one begins behind. (A large filter holds 8,738 features; no
    object of the tables has as many.)
    """
    return f"""{_votes_sql(objects)},
            f AS MATERIALIZED (SELECT r, row_number() OVER (PARTITION BY r ORDER BY p) AS i, sha1(x[p + 1 : p + 64]) AS h FROM votes JOIN o USING (r) WHERE score > 16),
            fb AS MATERIALIZED (SELECT r, i, v % 2048 AS small, v % 131072 AS large FROM (SELECT r, i, {_word_sql("w")} AS v FROM f, (SELECT unnest(range(0, 5)) AS w))),
            rec(r, k, stop, n, bits, seen) AS (
                SELECT r, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(160 AS BIGINT), []::BIGINT[], []::BIGINT[] FROM o
                UNION ALL
                SELECT r, any_value(k) + 1, any_value(coalesce(stop, last)), any_value(n), list(DISTINCT small), list_distinct(list_concat(any_value(seen), list(large))) FROM (
                    SELECT *, max(i) FILTER (place <= 160) OVER (PARTITION BY r) AS full_at, count(*) FILTER (counted AND once AND place <= 160) OVER (PARTITION BY r) AS n,
                        max(i) OVER (PARTITION BY r) AS last, max(CASE WHEN counted AND place = 160 THEN i END) OVER (PARTITION BY r) AS stop FROM (
                        SELECT *, sum(CAST(counted AND once AS INT)) OVER (PARTITION BY r ORDER BY i RANGE UNBOUNDED PRECEDING) AS place FROM (
                            SELECT *, bool_or(first_large) OVER (PARTITION BY r, i) AS counted, row_number() OVER (PARTITION BY r, i) = 1 AS once FROM (
                                SELECT *, min(i) OVER (PARTITION BY r, large) = i AND NOT list_contains(seen, large) AS first_large FROM (
                                    SELECT *, bool_or(first_small) OVER (PARTITION BY r, i) AS passed FROM (
                                        SELECT fb.*, k, seen, min(fb.i) OVER (PARTITION BY fb.r, small) = fb.i AS first_small
                                        FROM fb JOIN rec ON fb.r = rec.r AND fb.i > rec.stop AND rec.n = 160))
                                WHERE passed)))) WHERE i <= coalesce(stop, last) GROUP BY r),
            flt0 AS MATERIALIZED (SELECT r, k, n, bits, max(k) OVER (PARTITION BY r) AS last_k, sum(n) OVER (PARTITION BY r) AS total FROM rec WHERE k > 0),
            flt1 AS MATERIALIZED (SELECT r, k, n, bits, total FROM flt0 WHERE k = 1 OR k < last_k OR n >= 20
                UNION ALL SELECT r, 1, 0, [], 0 FROM o WHERE r NOT IN (SELECT r FROM flt0)),
            flt AS MATERIALIZED (SELECT r, k, n, CAST(len(bits) AS BIGINT) AS weight FROM flt1),
            bit AS MATERIALIZED (SELECT r, k, unnest(bits) AS b FROM flt1),
            dg AS MATERIALIZED (SELECT r, o.name, CAST(octet_length(any_value(x)) AS BIGINT) AS size, count(*) AS nf, CAST(any_value(total) AS BIGINT) AS total,
                count(*) FILTER (n < 16) AS sparse, max_by(n, k) AS last_n FROM flt1 JOIN o USING (r) GROUP BY r, o.name)"""


def _blocks_sql(objects: str, block: int) -> str:
    """Features that blocks count, `bf` (r, i, p, h), of blocks `o` (r, name, block, tail, x), each of which is an object of its own for votes.

    A block takes features of more than k votes, and of those with k as many as there is room for below 192.
    Ties behind the last one that counts are left out; what sets no new bit doesn't count.
    """
    blocks = f"""SELECT row_number() OVER () AS r, name, block, len < {block} AS tail, whole[block * {block} + 1 : block * {block} + len] AS x FROM (
                SELECT name, x AS whole, block, least({block}, octet_length(x) - block * {block}) AS len
                FROM (SELECT *, unnest(range(0, octet_length(x) // {block} + CASE WHEN octet_length(x) % {block} >= 512 THEN 1 ELSE 0 END)) AS block FROM ({objects})))"""
    new = "min(i) OVER (PARTITION BY r, small) = i"
    return f"""{_votes_sql(blocks)},
            hs AS (SELECT r, score AS s, count(*) AS n FROM votes WHERE score >= 16 GROUP BY ALL),
            cu AS (SELECT r, s, n, sum(n) OVER (PARTITION BY r ORDER BY s DESC) AS upto FROM hs),
            lim AS MATERIALIZED (SELECT o.r, CASE WHEN tail THEN 16 ELSE coalesce(max(s) FILTER (upto > 192), 15) END AS k,
                CASE WHEN tail THEN 192 ELSE 192 - coalesce(max_by(upto - n, s) FILTER (upto > 192), max(upto), 0) END AS allowed FROM o LEFT JOIN cu USING (r) GROUP BY o.r, tail),
            f AS MATERIALIZED (SELECT r, p, score = k AS tie, allowed, row_number() OVER (PARTITION BY r ORDER BY p) AS i, sha1(x[p + 1 : p + 64]) AS h
                FROM votes JOIN o USING (r) JOIN lim USING (r) WHERE score >= k AND (score > k OR allowed > 0)),
            fb AS MATERIALIZED (SELECT r, i, tie, allowed, v % 2048 AS small FROM (SELECT r, i, tie, allowed, {_word_sql("w")} AS v FROM f, (SELECT unnest(range(0, 5)) AS w))),
            n1 AS (SELECT r, i, tie, allowed, bool_or(first) AS counted FROM (SELECT *, {new} AS first FROM fb) GROUP BY ALL),
            n2 AS (SELECT r, i, tie AND sum(CAST(tie AND counted AS INT)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= allowed AS late FROM n1),
            n3 AS (SELECT r, i, bool_or(first) AS counted FROM (SELECT r, i, {new} AS first FROM fb JOIN n2 USING (r, i) WHERE late IS NOT true) GROUP BY ALL),
            n4 AS MATERIALIZED (SELECT r, i, counted, sum(CAST(counted AS INT)) OVER (PARTITION BY r ORDER BY i) AS place FROM n3),
            bf AS MATERIALIZED (SELECT r, i, p, h FROM n4 JOIN f USING (r, i) WHERE counted AND place <= 192)"""


def _pairs_sql(pairs: str, size: int = 2048) -> str:
    """Common bits m of all filters of pairs `pr` (a, b) of digests, with those among the first 256, 512 and 1024; `fo`: filters as strings of `size` bits."""
    first = ", ".join(f"bitstring_agg(b, 0, {size - 1}) FILTER (b < {n}) AS b{i}" for i, n in ((4, 256), (8, 512), (16, 1024)))
    common = ", ".join(f"coalesce(bit_count(x.b{i} & y.bits), 0) AS m{i}" for i in (4, 8, 16))
    return f"""pr AS MATERIALIZED ({pairs}),
            fo AS MATERIALIZED (SELECT r, k, n, count(*) AS weight, bitstring_agg(b, 0, {size - 1}) AS bits, {first} FROM (SELECT DISTINCT r, k, b % {size} AS b FROM bit) JOIN flt USING (r, k) GROUP BY r, k, n),
            co AS (SELECT a, x.k AS ka, b, y.k AS kb, x.n AS s1, y.n AS s2, least(x.weight, y.weight) AS most, bit_count(x.bits & y.bits) AS m, {common}
                FROM pr JOIN fo x ON x.r = a JOIN fo y ON y.r = b WHERE x.n >= 16 AND y.n >= 16)"""


def _compare_sql(pairs: str, *, fast: bool = False, sample: int = 0) -> str:
    """Scores `cmp` (query, target, score), those above 0, of pairs of digests; fast: of filters folded to 512 bits."""
    cut = "[" + ", ".join(map(str, t.CUTOFFS_64 if fast else t.CUTOFFS_256)) + "]"
    bits, exits = (1024, "2 * m4 + 48 < cut") if fast else (4096, "8 * m4 + 48 < cut OR 4 * m8 + 48 < cut OR 2 * m16 + 48 < cut")
    used = f"k <= {sample}" if sample else "true"
    return f"""{_pairs_sql(pairs, 512 if fast else 2048)},
            sc AS MATERIALIZED (SELECT a, ka, b, kb, (m - cut) / CAST(most - cut AS DOUBLE) AS s
                FROM (SELECT *, {cut}[CAST({bits} // (s1 + s2) AS INT) + 1] AS cut FROM co) WHERE m > cut AND NOT ({exits})),
            us AS (SELECT r, count(*) AS used, count(*) FILTER (n < 16) AS sparse, max_by(n, k) AS last_n FROM flt WHERE {used} GROUP BY r),
            -- the side with fewer filters is the reference
            sw AS MATERIALIZED (SELECT a, b, x.name AS query, y.name AS target, used > y.nf OR (used = y.nf AND (us.last_n > y.last_n OR x.name > y.name)) AS turned,
                used, us.sparse AS sx, y.nf AS ny, y.sparse AS sy FROM pr JOIN dg x ON x.r = a JOIN us ON us.r = a JOIN dg y ON y.r = b),
            su AS (SELECT a, b, sum(best) AS total FROM (
                SELECT a, b, CASE WHEN turned THEN kb ELSE ka END AS k, max(s) AS best FROM sc JOIN sw USING (a, b) WHERE turned OR ka <= used GROUP BY ALL) GROUP BY a, b),
            cmp AS (SELECT query, target, CAST(floor(100.0 * total / CASE WHEN turned THEN CASE WHEN ny > 1 THEN ny - sy ELSE ny END ELSE CASE WHEN used > 1 THEN used - sx ELSE used END END + 0.5) AS INT) AS score FROM su JOIN sw USING (a, b))"""


def _matrix_sql(pairs: str) -> str:
    """Scores `cmp` (reference, target, score) by the older formula; of a pair, a is the reference."""
    power = lambda n: f"pow(CAST(2047 AS DOUBLE) / 2048, 5 * ({n}))"
    return f"""{_pairs_sql(pairs)},
            sc AS (SELECT a, ka, b, greatest(max(CASE WHEN m > cut THEN round_even(100 * (m - cut) / (most - cut), 0) ELSE 0 END), 0) AS best
                FROM (SELECT *, 0.3::DOUBLE * (most - low) + low AS cut FROM (SELECT *, floor(2048 * (1 - {power("s1")} - {power("s2")} + {power("s1 + s2")}) + 0.5) AS low FROM co)) GROUP BY ALL),
            cmp AS (SELECT x.name AS reference, y.name AS target, CAST(CAST(sum(best) AS BIGINT) // any_value(x.nf - x.sparse) AS INT) AS score
                FROM sc JOIN dg x ON x.r = a JOIN dg y ON y.r = b GROUP BY a, b, x.name, y.name)"""


def oracle_sql() -> dict[str, str]:
    ranks, votes = "[" + ", ".join(map(str, t.default_ranks().tolist())) + "]", _votes_sql()
    cut = "[" + ", ".join(map(str, t.CUTOFFS_256)) + "]"
    index_bits = f"WITH {_WORDS}, b AS (SELECT DISTINCT source, v % 536870912 AS bit FROM word)"
    stream, both = f"WITH RECURSIVE {_digest_sql(_DOCUMENTS)}", f"WITH RECURSIVE {_digest_sql(f'{_DOCUMENTS} UNION ALL {_PAGES}')}"
    bb, pb = (f"WITH RECURSIVE {_blocks_sql(o, 16 << 10)} SELECT name, block, p, h FROM bf JOIN o USING (r)" for o in (_DOCUMENTS, _PAGES))
    later = "SELECT x.r AS a, y.r AS b FROM dg x JOIN dg y ON CAST(substr(x.name, 5) AS BIGINT) < CAST(substr(y.name, 5) AS BIGINT)"
    cross = "SELECT x.r AS a, y.r AS b FROM dg x JOIN dg y ON starts_with(x.name, 'page-') AND starts_with(y.name, 'doc-')"
    turned = "SELECT y.r AS a, x.r AS b FROM dg x JOIN dg y ON starts_with(x.name, 'page-') AND starts_with(y.name, 'doc-')"
    scored = "SELECT query, target, score FROM cmp WHERE score >= 1"
    pages = f"""WITH {_WORDS}, b AS (SELECT DISTINCT lpad(CAST(doc_id // 7 AS VARCHAR), 9, '0') AS index_set, v % {_NARROW + 1} AS bit FROM word),
            n AS (SELECT index_set, row_number() OVER (ORDER BY index_set) - 1 AS number FROM (SELECT DISTINCT index_set FROM b))"""
    return {
        "eligible_objects": f"""SELECT name, size FROM (
            SELECT 'doc-' || doc_id AS name, CAST({_SIZE} AS BIGINT) AS size FROM documents
            UNION ALL SELECT 'page-' || page_id, octet_length(encode(html)) FROM pages
            UNION ALL SELECT 'turn-' || conv_id || '-' || turn, {_SIZE} FROM conversations) WHERE size >= 512""",
        "size_router": f"""SELECT 'doc-' || doc_id AS name, CAST({_SIZE} AS BIGINT) AS size,
            CASE WHEN {_SIZE} < {LIMIT} THEN 'small' ELSE 'large' END AS size_class,
            CAST(CASE WHEN {_SIZE} < {LIMIT} THEN 0 ELSE 16 END AS INT) AS block_kib, CAST(4 AS INT) AS asked_kib FROM documents WHERE text IS NOT NULL""",
        "segment_plan": f"""WITH o AS (SELECT 'doc-' || doc_id AS name, CAST({_SIZE} AS BIGINT) AS size FROM documents WHERE text IS NOT NULL),
            n AS (SELECT name, size, CASE WHEN size <= {SEGMENT} OR size - {SEGMENT} <= 512 THEN 1 WHEN size % {SEGMENT} <= 512 THEN size // {SEGMENT} ELSE size // {SEGMENT} + 1 END AS n FROM o),
            s AS (SELECT name, size, n, unnest(range(0, n)) AS segment FROM n)
            SELECT name, CAST(segment AS BIGINT) AS segment, CASE WHEN n > 1 THEN name || '.' || lpad(CAST(segment * {SEGMENT} // 1048576 AS VARCHAR), 4, '0') || 'M' ELSE name END AS segment_name,
            CAST(segment * {SEGMENT} AS BIGINT) AS start, CAST(CASE WHEN segment = n - 1 THEN size - segment * {SEGMENT} ELSE {SEGMENT} END AS BIGINT) AS length FROM s""",
        "block_plan": f"""WITH o AS (SELECT 'doc-' || doc_id AS name, CAST({_SIZE} AS BIGINT) AS size FROM documents),
            s AS (SELECT name, size, unnest(range(0, size // {BLOCK} + CASE WHEN size % {BLOCK} >= 512 THEN 1 ELSE 0 END)) AS block FROM o WHERE size >= 512)
            SELECT name, CAST(block AS BIGINT) AS block, CAST(block * {BLOCK} AS BIGINT) AS start, CAST(least({BLOCK}, size - block * {BLOCK}) AS BIGINT) AS length,
            size - block * {BLOCK} < {BLOCK} AS tail FROM s""",
        "batch_plan": f"""WITH o AS (SELECT 'doc-' || doc_id AS name, CAST({_SIZE} AS BIGINT) AS size FROM documents)
            SELECT name, size, CAST(coalesce(sum(size) OVER (ORDER BY name NULLS FIRST, size NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {BATCH} AS INT) AS batch FROM o""",
        "window_entropy": f"WITH {_entropy_sql()} SELECT name, entropy, count(*) AS n FROM w GROUP BY r, name, entropy",
        "chunk_ranks": f"WITH {_entropy_sql()} SELECT name, CAST({ranks}[entropy + 1] AS INT) AS rank, count(*) AS n FROM w GROUP BY r, name, rank",
        "popularity_scores": f"""WITH {votes} SELECT name, coalesce(score, 0) AS score, count(*) AS n FROM k LEFT JOIN votes USING (r, p)
            WHERE p < size - 64 GROUP BY r, name, coalesce(score, 0)""",
        "stream_features": f"""WITH {votes} SELECT name, CAST(0 AS BIGINT) AS block, CAST(p AS BIGINT) AS offset, score, sha1(x[p + 1 : p + 64]) AS sha1
            FROM votes JOIN o USING (r) WHERE score > 16""",
        "compare_all": f"{stream}, {_compare_sql(later)} {scored}",
        "compare_fast": f"{stream}, {_compare_sql(later, fast=True)} {scored}",
        "compare_to": f"{both}, {_compare_sql(cross)} {scored}",
        "compare_sampled": f"{both}, {_compare_sql(cross, sample=1)} {scored}",
        "compare_matrix": f"{both}, {_matrix_sql(turned)} SELECT target, reference, score FROM cmp WHERE score >= 1",
        "index_search": f"""WITH known AS MATERIALIZED ({bb}), asked AS MATERIALIZED ({pb}),
            sz AS (SELECT name, CAST(coalesce(sum(size) OVER (ORDER BY name, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {256 * BATCH} AS INT) AS batch FROM (SELECT 'doc-' || doc_id AS name, {_SIZE} AS size FROM documents)),
            kb AS (SELECT DISTINCT 'documents' || batch AS index_set, v % 536870912 AS bit FROM (SELECT batch, {_word_sql("w")} AS v FROM known JOIN sz USING (name), (SELECT unnest(range(0, 5)) AS w))),
            an AS (SELECT name, block, p, h FROM (SELECT *, row_number() OVER (PARTITION BY name, block ORDER BY p) AS i FROM asked) WHERE i % 4 = 1),
            ab AS (SELECT DISTINCT name, block, p, v % 536870912 AS bit FROM (SELECT name, block, p, {_word_sql("w")} AS v FROM an, (SELECT unnest(range(0, 5)) AS w))),
            ac AS (SELECT name, block, p, count(*) AS n FROM ab GROUP BY ALL),
            hit AS (SELECT name, block, p, index_set FROM ab JOIN kb USING (bit) JOIN ac USING (name, block, p) GROUP BY name, block, p, index_set, n HAVING count(*) = n)
            SELECT name, block, index_set, CAST(count(*) AS INT) AS hits FROM hit GROUP BY name, block, index_set HAVING count(*) > 4""",
        "stream_distinct": f"""{stream}, body AS (SELECT r, list(row(k, n, list_sort(bits)) ORDER BY k) AS body FROM flt1 GROUP BY r)
            SELECT size AS input_size, count(DISTINCT body) AS digests FROM dg JOIN body USING (r) GROUP BY size""",
        "validate": f"{stream} SELECT count(*) AS lines, count(*) AS valid, CAST(sum(nf) AS BIGINT) AS filters, CAST(sum(size) AS BIGINT) AS input_size FROM dg",
        "large_digests": f"{stream} SELECT name, size AS file_size, CAST(1 AS INT) AS filter_count, total AS last_elements FROM dg",
        "feature_bits": f"WITH {_WORDS} SELECT doc_id, CAST(w AS INT) AS word, v % 2048 AS small_bit, v % 131072 AS large_bit FROM word",
        "bloom_build": f"WITH {_WORDS}, {_SOURCE} SELECT grp, CAST(n AS INT) AS elements, CAST(count(*) AS INT) AS hamming, round(2048.0 / n, 6) AS bits_per_element FROM e JOIN b USING (grp) GROUP BY grp, n",
        "bloom_bits": f"WITH {_WORDS}, {_SOURCE} SELECT grp, bit FROM b",
        "bloom_union": f"WITH {_WORDS}, {_PAIRS} SELECT a, b, CAST(h1 + h2 - m AS INT) AS hamming FROM q",
        "bloom_fold": f"WITH {_WORDS}, {_SOURCE} SELECT grp, CAST(count(DISTINCT bit % 512) AS INT) AS fast_hamming FROM b GROUP BY grp",
        "large_fold": f"WITH {_WORDS} SELECT lang AS grp, CAST(count(DISTINCT v % 131072) AS INT) AS hamming, CAST(count(DISTINCT v % 16384) AS INT) AS folded FROM word GROUP BY lang",
        "filter_overlap": f"""WITH {_WORDS}, {_PAIRS} SELECT a, b, CAST(m AS INT) AS overlap,
            CAST(round(2048 * (1 - pow(2047 / 2048.0::DOUBLE, 5 * s1) - pow(2047 / 2048.0::DOUBLE, 5 * s2) + pow(2047 / 2048.0::DOUBLE, 5 * (s1 + s2)))) AS INT) AS estimate FROM q""",
        "filter_score": f"""WITH {_WORDS}, {_PAIRS}, r AS (SELECT *, CAST({cut}[4096 // (s1 + s2) + 1] AS INT) AS cut FROM q)
            SELECT a, b, cut AS cutoff, round(CASE WHEN s1 < 16 OR s2 < 16 OR 8 * m4 + 48 < cut OR 4 * m8 + 48 < cut OR 2 * m16 + 48 < cut OR m <= cut THEN 0
            ELSE (m - cut) / CAST(least(h1, h2) - cut AS DOUBLE) END, 6) AS score FROM r""",
        "score_lines": "SELECT source || ',doc-' || doc_id || ',' || CASE WHEN doc_id % 102 = 0 THEN '-1' ELSE lpad(CAST(doc_id % 102 - 1 AS VARCHAR), 3, '0') END AS value FROM documents",
        "index_build": f"{index_bits} SELECT source AS index_set, 1 + bit // 32768 AS bucket, count(*) AS bits FROM b GROUP BY ALL",
        "index_merge": f"{index_bits} SELECT 'all' AS index_set, 1 + bit // 32768 AS bucket, count(DISTINCT bit) AS bits FROM b GROUP BY ALL",
        "index_probe": f"""{index_bits}, f AS (SELECT DISTINCT doc_id, v % 536870912 AS bit FROM word), n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id)
            SELECT CAST(doc_id AS VARCHAR) AS name, source AS index_set FROM f JOIN b USING (bit) JOIN n USING (doc_id) GROUP BY doc_id, source, n HAVING count(*) = n""",
        "index_elements": f"""WITH {_WORDS}, b AS (SELECT lang, v % {_NARROW + 1} AS bit, min(row(CAST(doc_id AS VARCHAR), h)) AS f FROM word GROUP BY ALL)
            SELECT lang AS index_set, count(DISTINCT f) AS elements FROM b GROUP BY lang""",
        "index_slices": f"""{pages}, w AS (SELECT bit, number // 128 AS part, number % 128 AS place FROM b JOIN n USING (index_set))
            SELECT bit, CAST(part AS INT) AS part, {", ".join(f"coalesce(bit_or(CASE WHEN place = 64 * {i} + 63 THEN -9223372036854775808 WHEN place // 64 = {i} THEN CAST(1 AS BIGINT) << (place % 64) END), 0) AS w{i}" for i in (0, 1))},
            CAST(count(*) AS INT) AS sets FROM w GROUP BY bit, part""",
        "sliced_probe": f"""{pages}, f AS (SELECT DISTINCT doc_id, v % {_NARROW + 1} AS bit FROM word), c AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id)
            SELECT CAST(doc_id AS VARCHAR) AS name, index_set FROM f JOIN b USING (bit) JOIN c USING (doc_id) GROUP BY doc_id, index_set, n HAVING count(*) = n""",
        "set_summary": f"SELECT set_name, items, filters, s AS input_size, {_HUMAN} AS size FROM ({_SUMMARY})",
        "set_listing_json": f"""SELECT CAST(to_json({{'aaData': list([substr(set_name, 4, 9), set_name, {_HUMAN}, CAST(items AS VARCHAR)] ORDER BY set_name)}}) AS VARCHAR) AS json FROM ({_SUMMARY})""",
        "result_status": """SELECT conv_id, CASE WHEN n % 3 = 0 THEN 'processing' ELSE 'complete (' || n || ' lines)' END AS status,
            CASE WHEN n % 3 = 0 THEN 1000 ELSE n END || 's' AS duration FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)""",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            eligible_objects, size_router, segment_plan, block_plan, batch_plan, feature_bits, bloom_build, bloom_bits,
            bloom_union, bloom_fold, large_fold, filter_overlap, filter_score, score_lines, window_entropy,
            chunk_ranks, popularity_scores, stream_features, stream_digest, block_digest, sized_digest, segment_digest, compare_all,
            compare_fast, compare_to, compare_sampled, compare_matrix, compare_blocks, digest_text_roundtrip, validate,
            index_build, index_merge, index_probe, index_elements, index_slices, sliced_probe, index_search, index_files, large_digests, large_compare,
            large_roundtrip, set_summary, set_listing_json, result_status, common_substrings, stream_ingest, stream_segments, stream_distinct,
        )
    }
