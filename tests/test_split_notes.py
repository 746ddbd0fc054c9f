"""Notes read in pieces: chunks and verdicts equal to those of notes read whole, at splits of a few bytes."""

import random

import pytest
from pyspark.sql import functions as F

from loomset.functions import rules
from loomset.operators import guardrails as G
from loomset.operators import notes as N
from loomset.plans import dataset
from loomset.sources import notes, split_notes

NUMBERS = ["555", "(555)", "4567", "123", "5551234567", "+1", "1", "555-123-4567", "555.123", "1234", "567", "10.0.0.1", "123-45-6789", "٥٥٥", "x+44"]
WORDS = ["word", "a.b@c.de", "é日本", "sk-" + "a1" * 12, "", " ", "\t", "bomb", "pipe", "\u2003", "\x1c", "user@host"]


def _note(seed, lines, numbers):
    rng = random.Random(seed)
    pick = lambda: rng.choice(NUMBERS if rng.random() < numbers else WORDS)
    said = [rng.choice(["", " "]).join(pick() for _ in range(rng.randint(0, 4))) for _ in range(lines)]
    return "".join(line + rng.choice(["\n", "\n", "\n", "\r\n", "\n\n", " \n"]) for line in said)


@pytest.fixture()
def folder(tmp_dir):
    bodies = {f"n{k}.txt": _note(k, 300, 0.3 * (k % 4)).encode() for k in range(12)}
    bodies["long line.md"] = b"w " * 3000 + b"\n555\n" + b"1234567 " * 900
    bodies["no+end.txt"] = b"one two\n" * 300 + b"555\n123\n4567"
    bodies["tied.txt"] = b"1234\n567\n" * 400 + b"end of it"
    bodies["dump.txt"] = b"5551234567\n" * 400
    bodies["harm.txt"] = b"fine words here\n" * 200 + b"a murder plan\n" + b"pornography ransomware\n" * 30
    bodies["broken.txt"] = b"caf\xc3\xa9 \xff\xfe \xe2\x82\n \xe2\x82\xac next\xc3\n" * 150
    bodies["mark.txt"] = b"\xef\xbb\xbfmarked \xef\xbb\xbf words 555\n123-4567 and more\n" * 120
    bodies["marked_end.json"] = b"\xef\xbb\xbf" + b"some words of a note without end " * 4
    bodies["blank.txt"] = b"\n\n \n\t\n" * 200
    bodies["empty.txt"] = b""
    bodies["other.csv"] = b"not a note\n"
    for name, body in bodies.items():
        with open(f"{tmp_dir}/{name}", "wb") as out:
            out.write(body)
    return tmp_dir


def _chunks(df):
    return sorted((r.file_path, r.file_name, r.chunk_index, r.chunk) for r in df.collect())


def test_pieces_join_to_the_whole_text(spark, folder):
    pieces = split_notes.read_pieces(spark, folder, split_bytes=97)
    found = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.file_path, r.block)):
        found.setdefault((r.file_path, r.file_name), []).append(r.text)
    whole = {(r.file_path, r.file_name): r.text for r in notes.read_notes(spark, folder).collect()}
    # the line break at a file's end has no line behind it
    assert {k: "\n".join(v) for k, v in found.items()} == {k: v.removesuffix("\n") for k, v in whole.items()}
    assert max(len(v) for v in found.values()) > 20
    dump = [v for (p, _), v in found.items() if p.endswith("dump.txt")][0]
    assert len(dump) > 40  # whole numbers on lines of their own tie nothing


@pytest.mark.parametrize(("split", "size"), [(61, 7), (2048, 500), (2048, 1), (1 << 20, 500)])
def test_chunks_equal_the_one_row_form(spark, folder, split, size):
    prepared = N.prepare_notes(notes.read_notes(spark, folder))
    pieces = N.prepare_pieces(split_notes.read_pieces(spark, folder, split_bytes=split))
    assert _chunks(N.chunk_pieces(pieces, size)) == _chunks(N.chunk_notes(prepared, size, ["file_path", "file_name"]))
    verdicts = {r.file_path: r[G.HARM] for r in N.note_verdicts(pieces).collect()}
    assert verdicts == {r.file_path: r[G.HARM] for r in prepared.select("file_path", G.HARM).collect()}
    assert "harm" not in verdicts.values() and "hacking" in verdicts.values()  # the table's order, not the text's


def test_random_numbers_over_line_breaks(spark, tmp_dir):
    rng = random.Random(5)
    for k in range(40):
        groups = [rng.choice(["555", "4567", "123", "1", "+1", "(555)", "55512", "x", "1234567"]) for _ in range(150)]
        with open(f"{tmp_dir}/r{k}.txt", "w") as out:
            out.write("".join(g + rng.choice(["\n", "\n", "-", " ", "\n\n", "."]) for g in groups))
    for split in (23, 200):
        pieces = N.prepare_pieces(split_notes.read_pieces(spark, tmp_dir, split_bytes=split))
        whole = N.chunk_notes(N.prepare_notes(notes.read_notes(spark, tmp_dir)), 40, ["file_path", "file_name"])
        assert _chunks(N.chunk_pieces(pieces, 40)) == _chunks(whole) != []


def test_switches_and_empty_folder(spark, folder, tmp_path):
    plain = N.prepare_pieces(split_notes.read_pieces(spark, folder, split_bytes=500), False, False)
    whole = N.prepare_notes(notes.read_notes(spark, folder), "text", False, False)
    assert _chunks(N.chunk_pieces(plain)) == _chunks(N.chunk_notes(whole, keep_cols=["file_path", "file_name"]))
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.txt").write_bytes(b"")
    assert split_notes.read_pieces(spark, str(tmp_path / "none")).collect() == []


def test_partly_read_file_is_left_out(spark, folder, monkeypatch):
    real = split_notes.with_lineage

    def losing(*args, **kwargs):
        lost = F.col("file").endswith("n1.txt") & (F.col("block") == 970)
        return real(*args, **kwargs).where(~lost)

    monkeypatch.setattr(split_notes, "with_lineage", losing)
    names = {r.file_name for r in split_notes.read_pieces(spark, folder, split_bytes=97).select("file_name").distinct().collect()}
    assert "n1.txt" not in names and "n2.txt" in names
    with pytest.raises(Exception, match="not read to its end"):
        split_notes.read_pieces(spark, folder, split_bytes=97, skip_unreadable=False).collect()


def test_dataset_from_pieces(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    one, many = f"{out}/one", f"{out}/many"
    whole = dataset.build_dataset(spark, "notes", folder, one, "alpaca", chunk_words=50)
    split = dataset.build_dataset(spark, "notes", folder, many, "alpaca", chunk_words=50, split_bytes=300)
    assert {k: v for k, v in whole.items() if k != "output"} == {k: v for k, v in split.items() if k != "output"}
    assert split["hacking"] == 1 < split["explosives"] == split["rejected"] - 1
    read = lambda p: sorted(r["value"] for r in spark.read.text(p).collect())
    assert read(one) == read(many) != []
    with pytest.raises(ValueError, match="fixed rule tables"):
        dataset.split_note_pieces(spark, folder, tables=rules.RuleTables())


def test_only_phones_match_line_breaks():
    """What reading in pieces rests on: no other fixed pattern has anything that a line break can match."""
    others = [p for kind, p in rules.PII_PATTERNS.items() if kind != "phone"] + [p for ps in rules.HARM_PATTERNS.values() for p in ps]
    for pattern in others:
        bare = pattern.replace(r"\.", "").replace(r"\b", "").replace(r"\d", "")
        assert "\\" not in bare and "[^" not in bare and "\n" not in bare, pattern
        assert "." not in "".join(piece.split("]")[-1] for piece in bare.split("[")), pattern
    assert rules.PII_PATTERNS["phone"].count(r"\s") == len(split_notes._SIDES) == rules.PII_PATTERNS["phone"].count(split_notes._SEPARATOR)
