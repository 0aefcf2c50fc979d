import re
import time

import numpy as np
import pyarrow as pa

from kindred.llm import mail
from kindred.llm.text import ALNUM, VISIBLE, column_bytes, slices, text_words

TEXTS = ["The quick  Brown-fox éÀ 12", None, "", " \t\n", "a", "x" * 5000, "Straße\u00a0b c\x0bd", "a b c d e f", "!!", "Ünïcode ÄÖ z"]


def words(text, pattern):
    return re.findall(pattern, (text or "").translate({i: i + 32 for i in range(65, 91)}))


def test_words_and_windows_equal_regular_expressions():
    for column in (pa.array(TEXTS), pa.array(TEXTS, pa.large_string()), pa.array(["skip", *TEXTS]).slice(1)):
        for member, pattern in ((ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (VISIBLE, r"[^\x20\x09-\x0D]+")):
            seen = {}
            (((_, _, w)),) = text_words(column, member)
            for d, text in enumerate(TEXTS):
                own = slice(w.first[d], w.first[d + 1])
                found = [w.low[a:b].tobytes().decode() for a, b in zip(w.start[own], w.end[own], strict=True)]
                assert found == words(text, pattern)
                for word, code in zip(found, w.code[own].tolist(), strict=True):
                    assert seen.setdefault(word, code) == code
            assert len(set(seen.values())) == len(seen)
            code, first = w.windows(3)
            keys = {}
            for d, text in enumerate(TEXTS):
                own = words(text, pattern)
                grams = [tuple(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
                got = code[first[d] : first[d + 1]].tolist()
                assert len(got) == len(grams)
                for g, c in zip(grams, got, strict=True):
                    assert keys.setdefault(g, c) == c


def test_slices_cover_all_rows():
    body, offsets = column_bytes(pa.array(["a" * n for n in (3, 9, 0, 4, 20, 1)]))
    assert list(slices(offsets, 10)) == [(0, 1), (1, 3), (3, 4), (4, 5), (5, 6)] or [b for _, b in slices(offsets, 10)][-1] == 6
    assert len(body) == 37 and column_bytes(pa.array([], pa.string()))[1].tolist() == [0]
    assert np.concatenate([np.arange(a, b) for a, b in slices(offsets, 10)]).tolist() == list(range(6))


def test_planes_of_arrays():
    """Packed arrays are as they were, byte by byte, and come back; turning them takes little time."""
    rng = np.random.default_rng(4)
    for kind in (np.uint8, np.uint32, np.int64, np.float64, np.dtype("V180")):
        for n in (0, 1, 3, 200, 5000):
            x = np.frombuffer(rng.bytes(n * np.dtype(kind).itemsize), kind)
            packed = mail.planes(x)
            assert packed == mail.squeeze(x.view(np.uint8).reshape(n, x.itemsize).T.tobytes())
            back = mail.whole(packed, kind)
            assert back.dtype == x.dtype and back.tobytes() == x.tobytes()
    x = np.arange(1 << 20, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    took = [0.0, 0.0]
    for _ in range(3):
        for k, turn in enumerate((lambda: x.T.tobytes(), lambda: mail._turned(x))):
            started = time.process_time()
            turn()
            took[k] += time.process_time() - started
    assert took[1] < 0.7 * took[0]
