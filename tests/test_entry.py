"""Registered queries against their SQL, on the smallest tables."""

import hashlib
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from kindred.functions import kernel, score
from kindred.functions import tables as t
from kindred.sources.segments import segment_bounds

DATA = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


def rows(frame):
    return sorted(tuple("NULL" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def tables():
    for f in os.listdir(DATA):
        duckdb.sql(f"CREATE OR REPLACE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return duckdb


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, tables, name):
    found, expected = entry.queries()[name](spark, DATA).toPandas(), tables.sql(SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


#: What is known of the results that SQL can't give.
KNOWN = {
    "stream_digest": lambda f, docs: dict(zip(f.name, f.input_size)) == {f"doc-{i}": len(x) for i, x in docs.items()} and all(w["hamming"] == sum(bin(int(v) & (1 << 64) - 1).count("1") for v in w["words"]) for x in f.filters for w in x),
    "block_digest": lambda f, docs: dict(zip(f.name, f.bf_count)) == {f"doc-{i}": len(x) // 1024 + (len(x) % 1024 >= 512) for i, x in docs.items()},
    "sized_digest": lambda f, docs: dict(zip(f.name, f["mode"])) == {f"doc-{i}": "block" if len(x) >= 4096 else "stream" for i, x in docs.items()},
    "segment_digest": lambda f, docs: f.input_size.sum() <= sum(map(len, docs.values())) and {n.rsplit(".", 1)[0] for n in f.name} == {f"doc-{i}" for i in docs},
    "compare_blocks": lambda f, docs: same_scores(f, {n: kernel.block_digest(x, 1024, t.default_ranks()) for n, x in docs.items()}, {n: kernel.stream_digest(x, t.default_ranks()) for n, x in docs.items()}, 10),
    "digest_text_roundtrip": lambda f, docs: sorted(f.name) == sorted(2 * [f"doc-{i}" for i in docs]) and all(line.startswith("sdbf") for line in f.line),
    "index_files": lambda f, docs: len(f) > 0 and (f.bytes > 100).all(),
    "large_compare": lambda f, docs: {(f"32-{k}", f"64-{k // 2}") for k in range(6)} <= set(zip(f["query"], f.target, strict=True)) and f.score[[f"{int(q[3:]) // 2}" == v[3:] for q, v in zip(f["query"], f.target, strict=True)]].min() > 50,
    "large_roundtrip": lambda f, docs: sorted(f.value) == sorted(f"page-{i} size {len(x)} filter count 1" for i, x in pages().items()),
    "common_substrings": lambda f, docs: {(r.conv_id, r.turn): r.ratio for r in f.itertuples()} == common(),
    "stream_segments": lambda f, docs: {(r.name.split(".parquet")[0], r.start, r.length, r.md5) for r in f.itertuples()} == file_segments(),
    "stream_ingest": lambda f, docs: set(f.name) == {f"doc-{i}" for i in docs},
}


def pages():
    found = duckdb.sql("SELECT page_id, html FROM pages").fetchall()
    return {i: x.encode() for i, x in found if len(x.encode()) >= 512}


def file_segments():
    out = set()
    for path in Path(DATA).rglob("*.parquet"):
        data = path.read_bytes()
        for a, n in segment_bounds(len(data), 1 << 17):
            if n >= 512:
                out.add((path.name.split(".parquet")[0], a, n, hashlib.md5(data[a : a + n]).hexdigest()))
    return out


def common():
    """Ratios of neighbouring turns, by growing each common run from its begin."""
    turns = {(c, n): x.encode() for c, n, x in duckdb.sql("SELECT conv_id, turn, text FROM conversations").fetchall()}
    out = {}
    for (conv, turn), x in turns.items():
        y = turns.get((conv, turn + 1))
        if y is not None:
            best = 0
            for i in range(len(x)):
                while i + best < len(x) and x[i : i + best + 1] in y:
                    best += 1
            out[conv, turn] = round(best / min(len(x), len(y)), 6) if x and y else 0.0
    return out


def same_scores(frame, queries, targets, threshold):
    """Whether a comparison has just the pairs whose scores, one by one, reach the threshold."""
    rows = lambda d: [{"elem_count": n, "words": np.frombuffer(b, "<i8").tolist()} for b, n in zip(d.filters, d.counts, strict=True)]
    names = [f"doc-{i}" for i in targets]
    others = score.Filters.of(names, [rows(d) for d in targets.values()])
    expected = set()
    for i, d in queries.items():
        own = score.Filters.of([f"doc-{i}"], [rows(d)])
        expected |= {(f"doc-{i}", n, int(s)) for n, s in zip(names, score.digest_scores(own, others)[0], strict=True) if s >= threshold}
    return len(expected) > 0 and {(r.query, r.target, r.score) for r in frame.itertuples()} == expected


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL) - {n for n in entry.queries() if n.startswith("op") or n == "pipeline"}))
def test_results(spark, tables, name):
    texts = tables.sql("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall()
    docs = {i: x.encode() for i, x in texts if len(x.encode()) >= 512}
    assert KNOWN[name](entry.queries()[name](spark, DATA).toPandas(), docs)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("pipeline", [True, False])
def test_rest_stands_alone(tmp_path, pipeline):
    """In a copy without the optional folders the other queries are still there, with the pipeline's file or without."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "kindred", tmp_path / "kindred", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries()), e.queries(); assert e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
