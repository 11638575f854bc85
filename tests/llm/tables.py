"""Small tables with what tables can hold: nulls, empty and very long texts, ties, repeated rows, further columns."""

import random

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


def documents(spark, empty: bool = False):
    base = prose(1, 200)
    near = base.split()
    near[100] = "changed"
    rows = [
        (1, base, "en", "a", len(base), "x"),
        (2, " ".join(near), "en", "a", 0, "x"),
        (3, base, "en", None, 0, None),
        (4, None, None, "b", None, None),
        (5, "", "en", "b", 0, ""),
        (6, "  \n\t ", "en", "b", 5, ""),
        (7, prose(2, 30_000), "en", "c", 0, ""),
        (8, prose(3, 120), "de", "c", 0, ""),
        (8, prose(3, 120), "de", "c", 0, ""),
        (9, "one two", "de", "", 0, ""),
        (None, prose(4, 80), "fr", "c", 0, ""),
        (10, "Élan  naïve CAFÉ Ａ\u0301 " + prose(5, 60), "fr", "c", 0, ""),
    ]
    # names that operators use for columns of their own
    return spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}
