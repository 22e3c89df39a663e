"""A small table of documents with what real tables hold: nulls, empty and long texts, copies, repeated rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, shard int, quality_score double, spans string, rank int"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def documents(seed=1, n=60):
    rng = random.Random(seed)
    base = words(rng, 120)
    passage = words(rng, 30)
    rows = []
    for k in range(n):
        kind = k % 12
        if kind == 0:
            text = base
        elif kind == 1:
            text = base.replace(base.split()[k % 100], "changed", 1)
        elif kind == 2:
            text = words(rng, 40) + "\n" + passage + "\n" + words(rng, 20)
        elif kind == 3:
            text = None if k % 2 else ""
        elif kind == 4:
            text = " \n\t "
        elif kind == 5:
            text = "Straße ÉCOLE naïve — " + words(rng, 30).upper() + " 日本語 <|endoftext|> x\x1cy it's I'M"
        elif kind == 6:
            text = "a " * (20 + k) + words(rng, 3)
        elif kind == 7:
            text = f'token = "{rng.randbytes(20).hex()}" AKIA{"Q7" * 8} Password:abcdEFGH12345678 {rng.randbytes(8).hex()}'
        elif kind == 8 and k < 12:
            text = words(rng, 30_000)
        elif kind == 9:
            text = words(rng, 5)
        else:
            text = "\n".join(words(rng, rng.randrange(3, 60)) for _ in range(rng.randrange(1, 6)))
        rows.append((k * 3, text, rng.choice(["en", "fr", None]), None if k % 5 == 0 else "src0", None if text is None else len(text), k, 99, 0.1, "x", 5))
    rows += [rows[14], rows[14], rows[2]]  # repeated rows
    rows.append((7, rows[2][1], None, None, None, None, None, None, None, None))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def save(spark, rows, path, **tables):
    frame(spark, rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)
