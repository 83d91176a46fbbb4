import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lamella.llm.quality_rules import js_distance, op5_quality_rules, quality_rules
from tests.llm.data import ODD, docs_of, prose


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times, inside, seen, dup = Counter(windows), set(), set(), 0
    for k, w in enumerate(windows):
        if times[w] > 1:
            inside.update(range(k, k + 5))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def texts():
    rng = random.Random(11)
    p = prose(rng, 30)
    return ODD + [p, p + "\n" + p, "a b c d e f " * 3, "w " * 40, "x y z v u\n" * 4, "p q r s | # <b>", p + " \n \n" + p[:80]] + [
        prose(rng, rng.randint(5, 300)) for _ in range(30)
    ]


def test_counts_and_base_rule(spark):
    rows = quality_rules(docs_of(spark, texts(), ["n_words", "kept", "_words"])).collect()
    assert len(rows) == len(texts())
    for r in rows:
        n, chars, symbols, dup, repeat = want = brute(texts()[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert not (r.base_failed and r.kept)


def test_divergence(spark):
    rng = random.Random(12)
    clean = [" ".join(rng.choice("the of and to in".split()) + " " + prose(rng, 2) for _ in range(40)) for _ in range(80)]
    junk = [" ".join(f"{w}###$$$" for w in prose(rng, 200).split()), prose(rng, 200).upper().replace(" ", "!! ")]
    df = docs_of(spark, clean + junk).withColumn("lang", F.lit("en"))
    rows = {r.doc_id: r for r in quality_rules(df).collect()}
    assert all(rows[k].kept and rows[k].class_distance < 0.3 for k in range(80))
    assert all(rows[k].class_distance > 0.33 and not rows[k].kept for k in (80, 81))
    other = {r.doc_id: r for r in quality_rules(df.withColumn("lang", F.lit("xx"))).collect()}
    assert all(r.class_distance is None and r.kept == (not r.base_failed) for r in other.values())


def test_js_distance(spark):
    def direct(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        m = [(a + b) / 2 for a, b in zip(p, q)]
        return math.sqrt(sum(x * math.log2(x / y) for side in (p, q) for x, y in zip(side, m) if x) / 2)

    rng = random.Random(13)
    pairs = [([rng.randint(0, 9) for _ in range(6)] + [1.0], [rng.randint(0, 9) for _ in range(6)] + [1.0]) for _ in range(20)]
    pairs += [([1.0, 0.0], [0.0, 1.0]), ([2.0, 2.0], [1.0, 1.0])]
    df = spark.createDataFrame([(list(map(float, p)), list(map(float, q))) for p, q in pairs], "p array<double>, q array<double>")
    for r in df.withColumn("d", js_distance(F.col("p"), F.col("q"))).collect():
        assert abs(r.d - direct(r.p, r.q)) < 1e-9 and 0 <= r.d <= 1
    empty = spark.createDataFrame([([0.0], [1.0])], "p array<double>, q array<double>")
    assert empty.select(js_distance(F.col("p"), F.col("q"))).first()[0] is None


def test_native_plan(spark):
    df = op5_quality_rules(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert quality_rules(docs_of(spark, [])).count() == 0


def test_text_without_common_words_goes(spark):
    """Clean prose has a fifth of common words, as the given tables have; gibberish has none."""
    rng = random.Random(14)
    common = "the of and to in a is that it for was on with as by at".split()

    def page(share):
        return " ".join(rng.choice(common) if rng.random() < share else "".join(rng.choices("abcdefgh", k=6)) for _ in range(400))

    texts = [page(0.2) for _ in range(60)] + [page(0.0), page(0.0)]
    df = docs_of(spark, texts).withColumn("lang", F.lit("en"))
    rows = {r.doc_id: r for r in quality_rules(df).collect()}
    assert all(rows[k].kept for k in range(60))
    assert not any(rows[k].kept or rows[k].base_failed for k in (60, 61))
