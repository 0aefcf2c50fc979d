import random
import time

from pyspark.sql import functions as F

from kindred.operators.ground_truth import common_ratio, longest_common_substring, overlap_score


def test_longest_common_substring():
    rng = random.Random(1)
    for _ in range(50):
        a, b = (bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(2))
        brute = max((j - i for i in range(len(a)) for j in range(i, len(a) + 1) if a[i:j] in b), default=0)
        assert longest_common_substring(a, b) == brute


def test_longest_common_substring_of_long_texts():
    """Two texts of a megabyte, with a passage of every size in common."""
    rng = random.Random(2)
    for n in (0, 1000, 65_537, 700_000):
        passage = rng.randbytes(n)
        a = rng.randbytes(500_000) + b"<" + passage + b">" + rng.randbytes(499_998 - n if n < 499_998 else 0)
        b = rng.randbytes(300_000) + b"[" + passage + b"]" + rng.randbytes(699_998 - n if n < 699_998 else 0)
        started = time.time()
        found = longest_common_substring(a, b)
        assert found == n if n else 3 <= found <= 8
        assert time.time() - started < 60
    assert longest_common_substring(b"ab" * 50_000 + b"x", b"y" + b"ab" * 40_000 + b"z" + b"a") == 80_000
    assert longest_common_substring(b"a" * 100_000, b"a" * 99_999 + b"b" + b"a" * 10) == 99_999


def test_ratio_of_columns(spark):
    rows = spark.createDataFrame([("abcd", "xbcx"), ("", "a"), (None, "a")], "a string, b string")
    assert [r[0] for r in rows.select(common_ratio(F.encode("a", "utf-8"), F.encode("b", "utf-8"))).collect()] == [0.5, 0.0, None]


def test_score_follows_the_overlap():
    scores = [overlap_score(share, 16) for share in (0, 0.1, 0.5, 1.0)]
    assert scores == sorted(scores) and scores[0] <= 2 and scores[-1] == 100
