"""Small fixtures: documents with nulls, copies, empty and very long texts, and extra columns with clashing names."""

import random

KIND = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the river stone garden window lantern copper meadow winter silver harbor paper engine valley orchard candle marble forest signal thunder".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


def documents(n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "\n".join(sentence(rng, rng.randint(4, 30)).capitalize() + "." for _ in range(rng.randint(1, 6)))
        rows.append([i, text, "en", f"src{rng.choice('0001234')}", len(text)])
    rows[3][1] = rows[90][1] = rows[91][1] = rows[2][1]
    rows[7][1] = None
    rows[8][1] = ""
    rows[9][1] = " \n\t "
    rows[10][1] = sentence(rng, 9000) + "."
    rows[11][1] = rows[12][1] = "x" * 50_000
    rows[13][3] = rows[14][3] = None
    rows[15][1] = rows[16][1].replace("0", "7", 1)
    rows[17][1] = ("same words again here now " * 8).strip()
    rows[18][1] = "Line one stays.\n" * 5 + "Tail."
    return [tuple(r) for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, KIND)


def with_clashes(df, *names):
    from pyspark.sql import functions as F

    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    return df
