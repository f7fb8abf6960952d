"""Small messy tables and plain versions of what the operators compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns with names that operators also use inside.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row string, size long, key string, bucket long, score double, h long"
)


def rows_of(texts, first=0, source="a"):
    return [(first + i, t, "en", source, len(t or ""), "r", 1, "k", 2, 0.5, 3) for i, t in enumerate(texts)]


def prose(seed, n, letters="abcdefghij"):
    random_ = random.Random(seed)
    return " ".join("".join(random_.choices(letters, k=random_.randint(2, 7))) for _ in range(n))


def messy_texts():
    base = prose(1, 120)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    far = " ".join([*words[:60], *prose(2, 60).split(" ")])
    passage = prose(3, 40)
    return [
        base, base, near, far, None, "", " \n\t ", "one", "one two", "One TWO", "one two three four five",
        "a b c d e f", base.upper(), f"{prose(4, 30)}\n{passage}\n{prose(5, 30)}", f"{prose(6, 30)}\n{passage}",
        "x" * 400, "xy" * 300, ("é" * 120) + "ß", "same line here\n" * 40, prose(7, 4000), "   ", "\x00\x01 bin",
        *(" ".join([*words[:k], f"w{k}", *words[k + 1 :]]) for k in range(0, 100, 9)),
    ]


def messy_docs(spark):
    rows = rows_of(messy_texts())
    rows += [rows[3], rows[3]]  # repeated rows
    rows.append((None, "no id at all " * 12, None, None, None, None, None, None, None, None, None))
    rows.append((900, prose(9, 20), None, None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
