"""Documents with everything that is awkward in them, and helpers."""

import random

import duckdb

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, h long, fp long, spans string, score double"
EXTRA = (7, "x", 1, 2, "y", 0.5)  # names that operators use inside


def prose(seed, n):
    rng = random.Random(seed)
    words = ["Haus", "the", "river", "était", "niño", "run.", "of", "Straße,", "lorem", "and", "día", "vous", "ist", "is"]
    return " ".join(rng.choice(words) + (rng.choice("abcdefgh") if rng.random() < 0.7 else "") for _ in range(n))


PASSAGE = prose(99, 120)

TEXTS = [
    (0, prose(0, 200), "en", "a"),
    (1, None, None, None),
    (2, "", "en", "a"),
    (None, "a text without an id, mail x@y.org", "en", "b"),
    (3, prose(0, 200), "en", "a"),
    (3, prose(0, 200), "en", "a"),
    (4, " \t\n\x0b\x0c\r ", "de", "b"),
    (5, "12345 !!! ---", "de", None),
    (6, prose(6, 20_000), "fr", "a"),
    (7, "x" * 30_000, "es", "c"),
    (8, "é😀 ñ\x00\x1c\x85 a b　c <|endoftext|> d", "es", ""),
    (9, prose(1, 50) + "\n" + PASSAGE + "\n" + prose(2, 60), "fr", "b"),
    (10, prose(3, 70) + " " + PASSAGE + prose(4, 30), "de", "c"),
    (11, PASSAGE * 2 + "ab" * 600, "de", "c"),
    (12, prose(0, 200).replace("river", "rivers", 1), "en", "b"),
    (13, "a", "en", "a"),
    (14, "one two", "en", "a"),
    (-5, "MAIL a.b@c.de_f@g.h. 1.2.3.4.5 256.1.1.1 4539 1488 0343 6467 +1 (017) 555-7713", "en", "b"),
]


def docs(spark, rows=TEXTS):
    data = [(i, t, l, s, None if t is None else len(t), *EXTRA[:6]) for i, t, l, s in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def unique(rows=TEXTS):
    """Without null or repeated ids."""
    seen = {}
    for r in rows:
        if r[0] is not None:
            seen.setdefault(r[0], r)
    return list(seen.values())


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def in_sql(df, sql):
    con = duckdb.connect()
    documents = df.toArrow()
    con.register("documents", documents)
    return con.sql(sql)


def same(df, relation):
    def rows(columns, values):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(repr([round(v[i], 6) if isinstance(v[i], float) else v[i] for i in order]) for v in values)

    assert sorted(df.columns) == sorted(relation.columns)
    got, want = rows(df.columns, map(tuple, df.collect())), rows(relation.columns, relation.fetchall())
    assert got == want
