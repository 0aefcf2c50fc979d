import numpy as np

from kindred.__main__ import main


def test_digest_compare_index(spark, tmp_path, capsys):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 40_000).astype(np.uint8).tobytes()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(data)
    (tmp_path / "in" / "b").write_bytes(data[5000:])
    (tmp_path / "in" / "c").write_bytes(rng.integers(0, 256, 9000).astype(np.uint8).tobytes())
    source = str(tmp_path / "in")
    assert main([source, "--output", str(tmp_path / "sdbf")]) == 0
    assert main(["--compare", str(tmp_path / "sdbf"), "--separator", "csv"]) == 0
    lines = capsys.readouterr().out.split()
    assert len(lines) == 1 and int(lines[0].split(",")[2]) > 50
    assert main(["--gen-compare", source, "-t", "0"]) == 0
    assert len(capsys.readouterr().out.split()) == 3
    assert main(["--validate", str(tmp_path / "sdbf")]) == 0
    assert "3 of 3 digests valid" in capsys.readouterr().out
    assert main(["--index", "known", f"{source}/a", "--output", str(tmp_path / "idx")]) == 0
    assert main(["--index-search", str(tmp_path / "idx"), source]) == 0
    assert {line.split("/")[-1].split(" ")[0] for line in capsys.readouterr().out.splitlines()} == {"a", "b"}
    assert main(["--compare"]) == 2 and main(["--index", "x", source]) == 2
    (tmp_path / "cfg").write_text("nonsense=1\n")
    assert main(["--config-file", str(tmp_path / "cfg"), source]) == 2


def test_segments_streams_and_large_digests(spark, tmp_path, capsys, monkeypatch):
    import io
    import sys

    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, (2 << 20) + 90_000).astype(np.uint8).tobytes()
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "big").write_bytes(data)
    (tmp_path / "in" / "deep" / "small").write_bytes(data[:30_000])
    (tmp_path / "in" / "tiny").write_bytes(b"x" * 100)
    source = str(tmp_path / "in")
    assert main([source, "-z", "1"]) == 0
    names = sorted(line.split(":")[3] for line in capsys.readouterr().out.split())
    assert names == [f"{source}/big.000{i}M" for i in range(3)]
    assert main([source, "-z", "1", "--deep"]) == 0
    assert sum("deep/small" in line for line in capsys.readouterr().out.split()) == 1

    class Stdin:
        buffer = io.BytesIO(data)

    monkeypatch.setattr(sys, "stdin", Stdin)
    assert main(["-", "-z", "1", "--hash-name", "pipe"]) == 0
    lines = capsys.readouterr().out.split()
    assert sorted(line.split(":")[3] for line in lines) == [f"pipe.000{i}M" for i in range(3)] and all(line.startswith("sdbf-dd") for line in lines)
    assert main(["--large", "-o", str(tmp_path / "lg"), source, "--deep"]) == 0
    written = capsys.readouterr().out.split()
    assert written and all(f.endswith(".sdbflg") for f in written)
    assert main(["--details", str(tmp_path / "lg")]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 2
    assert main(["--compare", str(tmp_path / "lg"), "--large", "-t", "0"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 1
