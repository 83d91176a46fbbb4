"""Small awkward tables shared by the tests of the text operators."""

from __future__ import annotations

import random

SYLLABLES = "an er on the re ti in ed es or ha st ou at ion ing bel ßü é ñ".split()


def prose(rng: random.Random, words: int) -> str:
    out = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return " ".join(w + rng.choice(["", "", "", ",", ".", ".\n"]) for w in out)


#: Texts at the edges: null, empty, blank, other scripts, marks, special strings, long runs.
ODD = [
    None,
    "",
    " ",
    "\n\n",
    "a",
    "  two  spaces   three\t\ttabs \n \n end ",
    "it's we'll THEY'RE I'd don't 'tis '",
    "<|endoftext|>hello<|endoftext|><|endo<|startoftext|>x",
    "ΟΔΥΣΣΕΥΣ Σ İstanbul ǅ ŉ",
    "日本語のテキスト、漢字 ไทย हिन्दी",
    "é ñ J̌ combining ́",
    "emoji 😀😀👩‍👩‍👧 \x00\x01\x1c \x85     x",
    "²³¹ ¼½¾ 1234567890 ١٢٣",
    "x" * 700,
    " " * 600 + "z",
    "########!!!!" * 40,
]

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, extra=()):
    """A documents table, with columns whose names clash with those the operators make."""
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for name in extra:
        df = df.withColumn(name, F.lit(1))
    return df
