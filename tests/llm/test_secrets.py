"""The character models: scores against plain Python, precision and recall on labelled strings, whole redaction."""

import math
import random
import string

import pytest
from pyspark.sql import functions as F

from citemill.llm import markov_secrets as ms

SMALL = "doc_id long, text string"
WORDS = (
    "server configuration manager should return database connection results while processing request handler error"
    " message default value update account number session user invoice payment reference customer address"
).split()
LONG_WORDS = "Verwaltung Einstellungen Geschwindigkeitsbegrenzung Datenverarbeitung Berechtigung anticonstitutionnellement".split()


def _secrets(rnd):
    def some(alphabet, low, high):
        return "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(low, high)))

    mixed = string.ascii_letters + string.digits
    kinds = (mixed + "+/", mixed, string.ascii_lowercase + string.digits, string.ascii_letters, "0123456789ABCDEF")
    return [some(kind, 20, 48) for kind in kinds for _ in range(60)]


def _names(rnd):
    pick = lambda n, words=WORDS: rnd.sample(words, n)
    found = []
    for i in range(60):
        found += ["_".join(pick(4)), "-".join(pick(4)), "".join(w.capitalize() for w in pick(4)), "_".join(pick(4)).upper()]
        found += ["/".join(["usr", "local", "share", *pick(2)]), "-".join(pick(3, LONG_WORDS))]
        found += ["2024-01-%02d-%s-notes-v%d" % (i % 28 + 1, "-".join(pick(2)), i)]
        found += ["-".join("".join(rnd.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12))]
    return [name for name in found if len(name) >= 20]


@pytest.fixture(scope="module")
def model(some_docs):
    return ms.train(some_docs)


def test_precision_and_recall(spark, model):
    """On random strings of five alphabets and on names, paths, dates, long words and UUIDs, none seen in training."""
    rnd = random.Random(11)
    labelled = [(True, s) for s in _secrets(rnd)] + [(False, s) for s in _names(rnd)]
    frame = spark.createDataFrame([(i, f"see {s} there") for i, (_, s) in enumerate(labelled)], SMALL)
    found = {r.doc_id for r in ms.scan(frame, model).where("size(markov) > 0").collect()}
    right = sum(labelled[i][0] for i in found)
    recall, precision = right / sum(s for s, _ in labelled), right / len(found)
    assert recall >= 0.98 and precision >= 0.99, (recall, precision)


def test_scores_equal_plain_python(spark, some_docs):
    strings = [tuple(r) for r in ms.labelled_strings(some_docs).select("random", "s").collect()]
    counts = {}
    for kind, s in strings:
        for a, b in zip(s, s[1:]):
            if a in ms.ALPHABET and b in ms.ALPHABET:
                counts[kind, a + b] = counts.get((kind, a + b), 0) + 1

    def chance(kind, mix, a, b):
        total = sum(counts.get((kind, a + c), 0) for c in ms.ALPHABET)
        share = counts.get((kind, a + b), 0) / total if total else 1 / len(ms.ALPHABET)
        return math.log(mix / len(ms.ALPHABET) + (1 - mix) * share)

    def score(s):
        steps = list(zip(s, s[1:]))
        return sum(chance(True, ms.RANDOM_MIX, a, b) - chance(False, ms.IDENTIFIER_MIX, a, b) for a, b in steps) / len(steps)

    rnd = random.Random(2)
    tokens = _secrets(rnd)[::20] + _names(rnd)[::20]
    model = ms.train(some_docs)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string")
    rows = frame.select("i", ms.likelihood_ratio(F.col("t"), model.ratios).alias("score")).collect()
    for r in rows:
        assert math.isclose(r.score, score(tokens[r.i]), rel_tol=1e-9, abs_tol=1e-9)


def test_models_do_not_depend_on_the_amount():
    counts = {(kind, a + b): 1 + (ord(a) * 7 + ord(b)) % 5 for kind in (True, False) for a in "abcdef" for b in "abcdef"}
    many = {k: 10**6 * n for k, n in counts.items()}
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(ms.ratios_of(counts), ms.ratios_of(many)))


def test_threshold_parts_labelled_scores():
    scores = {(False, s): 1000 for s in range(-20, 10)} | {(False, 12): 1} | {(True, s): 50 for s in range(40, 60)}
    # One ordinary string in 30,001 may be called random; random ones begin at 40.
    assert ms.fitted_threshold(scores) == (10 + 0.5 * 30) / ms.SCORE_STEPS
    assert ms.fitted_threshold({(True, 3): 1}) == ms.THRESHOLD


def test_nothing_of_a_secret_is_left(spark, model):
    whole = "sk-deadbeefdeadbeefQx7ZpL0vT9wK2mNbYc5"
    uuid = "550e8400-e29b-41d4-a716-446655440000"
    texts = [f"a {whole} b", f"id {uuid}.", "hash 0123456789abcdef0123456789abcdef only", 'x password = "Qx7ZpL0vT9wK2mNbYc5!"', None]
    frame = spark.createDataFrame(list(enumerate(texts)), SMALL)
    found = {r.doc_id: r.text for r in ms.redact(frame, model).collect()}
    assert found == {0: "a [secret] b", 1: texts[1], 2: "hash [secret] only", 3: 'x [secret]!"', 4: None}
    spans = {r.doc_id: r.spans for r in ms.scan(frame, model).select("doc_id", ms.listed(ms.KINDS).alias("spans")).collect()}
    # The base span stays, the whole token is added; a known form alone is not listed twice.
    assert spans[0] == "markov:2:40,hex:5:21" and spans[1] == "" and spans[2] == "hex:5:37"
    assert spans[3] == "assign:2:33"
