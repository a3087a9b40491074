"""Documents with every awkward case, and plain-Python versions of the base rules."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, r1 long, node string, _row string, kept string, cell int, copy string, `a.b` int"


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', '', ',', '.'])}" for _ in range(n))


def documents(seed=0):
    """(doc_id, text, lang, source): prose with copies, near copies, shared passages, shared lines,
    one very long text, empty and null values, equal rows, and one id with two texts."""
    rng = random.Random(seed)
    shared = sentence(rng, 60)
    near = sentence(rng, 120)
    banner = "Read more of this on the front page of all our sites"
    rows = []

    def add(i, text, source=None, lang="en"):
        rows.append((i, text, lang, source if source is not None else f"site{rng.randrange(10)}"))

    for i in range(60):
        lines = [sentence(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), "  " + banner + " ")
        if i % 7 == 0:
            lines.append(shared)
        add(i, "\n".join(lines), f"site{i % 10}")
    for i in range(60, 75):  # near copies of one text
        w = words(near)
        for k in range(i % 4):
            w[rng.randrange(len(w))] = f"x{i}{k}"
        add(i, " ".join(w))
    for i in range(75, 90):
        add(i, rows[2][1])
    add(90, sentence(rng, 20_000, 5_000))
    add(91, None)
    add(92, "")
    add(93, " \t\n\x0b\f\r ")
    add(94, "one two")
    add(95, "ONE two")
    add(96, "é😀 ñ " * 40)
    add(97, "aaaa" * 300)
    add(98, "The The The The The The The The The The")
    add(99, rows[3][1], lang=None)
    rows.append((100, rows[4][1], None, None))
    rows.append((101, None, None, None))
    rows.append((None, rows[5][1], "en", "site1"))
    rows.append((None, None, None, None))
    rows.append((102, rows[6][1], "en", "site2"))
    rows.append((102, rows[6][1], "en", "site2"))
    rows.append((103, rows[7][1], "xx", ""))
    rows.append((103, sentence(rng, 40), "xx", "site3"))
    rng.shuffle(rows)
    return rows


def frame(spark, rows=None):
    """With columns that operators might use themselves."""
    rows = documents() if rows is None else rows
    return spark.createDataFrame([(*r, len(r[1] or ""), -1, "n", "row", "k", 7, "c", 5) for r in rows], SCHEMA)


def spread(rows):
    """Rows as text, sorted: for comparing bags of rows."""
    return sorted(map(repr, rows))
