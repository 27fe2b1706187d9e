"""The journal source over files that grow, rotate, shrink and end in the middle of a line."""

import json
import os

from convlake.sources import journal_files as J

SCHEMA = "n long, kind string"


def lines(*ns):
    return "".join(json.dumps({"n": n, "kind": "é" * (n % 5)}, ensure_ascii=False) + "\n" for n in ns)


def append(path, text):
    with open(path, "ab") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def polled(spark, folder, out, part_bytes=37):
    """What a new start of the query adds to its sink, in the order of the journal."""
    before = set(os.listdir(out)) if os.path.isdir(out) else set()
    rows = J.journal_events(J.journal_lines(spark, f"{folder}/journal", part_bytes), SCHEMA)
    rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    new = [f"{out}/{f}" for f in os.listdir(out) if f.endswith(".parquet") and f not in before]
    return sorted(r.n for r in spark.read.schema(f"file string, offset long, {SCHEMA}").parquet(*new).collect()) if new else []


def test_nothing_is_lost_or_doubled(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    live = folder / "journal.jsonl"
    assert polled(spark, folder, out) == []
    whole = lines(3).encode()
    append(live, lines(1, 2).encode() + whole[:-4])  # the third line is still being written
    assert polled(spark, folder, out) == [1, 2]
    append(live, whole[-4:] + b"\n  \nnot json\n[1]\n" + lines(4).encode())
    append(folder / "other.txt", lines(99))
    assert polled(spark, folder, out) == [3, 4]
    assert polled(spark, folder, out) == []
    append(live, lines(5))
    os.rename(live, folder / "journal.jsonl.1")  # rotation before the fifth line was read
    append(live, lines(6, 7))
    assert polled(spark, folder, out) == [5, 6, 7]
    append(folder / "journal.jsonl.1", lines(8))
    with open(live, "wb") as f:  # truncation
        f.write(lines(9).encode())
    assert polled(spark, folder, out) == [8, 9]
    with open(live, "wb") as f:  # copy, then truncate: the copy has been read already
        f.write(lines(10).encode())
    append(folder / "journal.jsonl.2", lines(9))
    append(folder / "journal.jsonl.3", lines(*range(100, 160)))
    assert polled(spark, folder, out) == [10, *range(100, 160)]
    os.remove(folder / "journal.jsonl.3")
    assert polled(spark, folder, out) == []


def test_pieces_are_cut_at_lines_whatever_their_size(tmp_path):
    text = lines(*range(40)).encode() + b"\n\n" + b'{"n": 1' + b"0" * 300 + b"}\n"
    append(tmp_path / "journal", text + b"{")
    expected = [line for line in text.decode().split("\n") if line.strip()]
    for size in (1, 2, 7, 30, 1000, 10**6):
        reader = J.JournalReader({"path": f"{tmp_path}/journal", "partbytes": size})
        end = reader.latestOffset()
        pieces = reader.partitions(reader.initialOffset(), end)
        rows = [r for p in pieces for r in reader.read(p)]
        assert [r[2] for r in rows] == expected
        assert all(text[at:].startswith(line.encode()) for _, at, line in rows)
        assert list(J.position(json.dumps(end)).values()) == [len(text)]


def test_a_file_renamed_between_planning_and_reading(tmp_path):
    append(tmp_path / "journal", lines(1, 2))
    reader = J.JournalReader({"path": f"file://{tmp_path}/journal"})
    pieces = reader.partitions({"files": {}}, reader.latestOffset())
    os.rename(tmp_path / "journal", tmp_path / "journal.1")
    append(tmp_path / "journal", lines(3))
    assert [json.loads(r[2])["n"] for p in pieces for r in reader.read(p)] == [1, 2]
    os.remove(tmp_path / "journal.1")
    try:
        list(reader.read(pieces[0]))
    except FileNotFoundError as e:
        assert "rotated away" in str(e)
    else:
        raise AssertionError("a lost file must not pass for an empty one")
