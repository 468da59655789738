"""Small documents with everything that may go wrong, and plain Python versions of the operators."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, label string, node long, band long, rid long, th long, size long, shard int, key long, n int, h long, site string, found string, score double"
WORDS = ["the", "river", "runs", "past", "old", "mills", "and", "quiet", "farms", "where", "people", "still", "keep", "bees", "for", "honey", "near", "stone", "walls", "under", "elm", "trees", "all", "summer", "long"]
LONG = " ".join(WORDS[(i * 7 + i // 25) % 25] + ("s" if i % 11 == 0 else "") for i in range(30_000))
BASE = " ".join(WORDS[(i * 3 + i // 25) % 25] + str(i % 17) for i in range(60))


def near(edits):
    words = BASE.split()
    for i in edits:
        words[i] = f"changed{i}"
    return " ".join(words)


ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, "Hello world", "en", "a"), (5, "Hello  world\n", "en", "b"),
    (6, BASE, "en", "a"), (7, near([30]), "en", "b"), (8, near([59]), "en", None), (9, near([5, 25, 45]), "en", "c"), (10, BASE.upper(), "en", "c"),
    (11, LONG, "en", "a"), (12, LONG + " tail", "en", "b"), (None, "no id here", None, "a"), (13, "twin row", "en", "a"), (13, "twin row", "en", "a"), (14, "12345 !!! 678", "en", "a"),
    (15, "Привет мир 🙂 日本語 é", "ru", "x"), (16, "one", "en", "a"), (17, "ONE", "en", "b"), (18, "x" * 50_000, "en", "b"), (None, "twin null", "en", "a"), (None, "twin null", "en", "a"),
]


def docs(spark, rows=None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(*r, len(r[1] or ""), True, "l", 1, 2, 3, 4, 5, 6, 7, 8, 9, "s", "f", 0.5) for r in rows], SCHEMA)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def components(texts, percent):
    """Least id that each id reaches, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
