"""Documents for the tests of this folder."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, data binary, pack long, rest string, fp long, copy string, bucket int, size int, parts0 string, row_id0 int"


def rows(spark, pairs):
    """Documents (doc_id, text) with further columns, some named like the operators' own."""
    filled = [(i, t, "en", "s", len(t) if t else 0, b"x", k, "r", 1, "c", 2, 3, "p", 4) for k, (i, t) in enumerate(pairs)]
    return spark.createDataFrame(filled, SCHEMA)


WORDS = "the quick brown fox jumps over a lazy dog while seven bright stars shine above old stone bridges near quiet rivers".split()


def prose(seed, n):
    """``n`` words that look random, always the same for a seed."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 13) % 97))
    return " ".join(out)


def odd_documents():
    """Null, empty, blank, short, long, repeated and non-ASCII texts, null and repeated ids."""
    passage = prose(99, 20)
    return [
        (1, prose(1, 120)),
        (2, prose(1, 120)),
        (2, prose(1, 120)),
        (3, prose(3, 30) + " " + passage + " " + prose(4, 30)),
        (4, prose(5, 10) + " " + passage),
        (5, None),
        (6, ""),
        (7, " \t\n "),
        (None, prose(3, 30) + " " + passage),
        (None, None),
        (8, "a" * 5000),
        (9, "a" * 60),
        (10, "héé €uro 日本語 " * 40),
        (11, "x " + "héé €uro 日本語 " * 40),
        (12, "one"),
        (13, "!! " * 300),
        (14, "<|endoftext|> and \x00 null\x1c\x85 end"),
        (15, prose(15, 30000)),
    ]
