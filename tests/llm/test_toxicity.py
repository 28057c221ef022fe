"""The composed grammar against a plain reading of its rules, and what it says of sentences."""

import random

import pytest

from bytemill.llm import toxicity as tox

WEIGHT = {tox.INSULT: 5.0, tox.DIRT: 4.0}


def plain(symbols, model):
    """Word by word, with the rules written out; no transducer."""
    total, written = 0.0, []
    negated_from = reported = aimed = None
    phrase, pending = 0, None
    for i, s in enumerate(symbols):
        hit = None
        # insult
        if s == tox.DIRT and phrase == 2:
            hit = (tox.INSULT, 4.0, 1.0)
        elif s == tox.INSULT:
            hit = (tox.INSULT, 5.0, 1.0)
        phrase = 1 if s == tox.HEAD else 2 if s == tox.FROM and phrase == 1 else 0
        # threat: pending is (kind, place); it reaches REACH words
        kind = pending[0] if pending and i - pending[1] <= tox.REACH else None
        if s == tox.TARGET:
            if kind in ("act", "announced act"):
                hit = (tox.THREAT, model.threat, 1.0 if kind == "announced act" else 0.5)
            pending = ("target", i)
        elif s == tox.SOON:
            pending = ("announced target" if kind == "target" else "soon", i)
        elif s == tox.ACT:
            pending = ("announced act" if kind == "soon" else "act", i)
        elif s == tox.END and kind in ("target", "announced target"):
            hit = (tox.THREAT, model.threat, 1.0 if kind == "announced target" else 0.5)
            pending = None
        elif s == tox.THREAT:
            hit = (tox.THREAT, model.threat, 1.0)
        if hit:
            name, value, factor = hit
            if negated_from is not None and i - negated_from <= tox.REACH:
                factor *= model.negated
            if reported:
                factor *= model.reported
            if aimed and name == tox.INSULT:
                factor *= 1.25
            written.append(value * factor)
            aimed = aimed or name == tox.THREAT
        elif s == tox.NEGATION:
            negated_from = i
        elif s == tox.REPORT:
            reported = True
        elif s == tox.TARGET:
            aimed = True
        total += 0 if not hit else written[-1] if len(written) == 1 else 0.25 * written[-1]
    return total


def test_composition_reads_like_the_rules():
    model = tox.Model()
    reader, rng = tox.Reader(model), random.Random(2)
    for _ in range(20_000):
        symbols = rng.choices(tox.SYMBOLS, k=rng.randint(1, 9))
        got = reader.weigh([(s, WEIGHT.get(s, 0.0)) for s in symbols])[0]
        assert got == pytest.approx(plain(symbols, model)), symbols


def test_each_transducer_changes_what_is_read():
    reader = tox.Reader(tox.Model())
    weigh = lambda t: reader.evidence(t)[0]
    assert weigh("what a piece of trash") > 0 == weigh("a piece of cake and the trash")
    assert weigh("i am going to hurt you") > weigh("hurt you") > 0 == weigh("it is going to hurt")
    assert weigh("you will die") > weigh("you die") > 0 == weigh("we all will die")
    assert weigh("you idiot") > weigh("an idiot") > weigh("he wrote idiot") > 0
    assert weigh("i will not hurt you") < weigh("i will hurt you")
    assert weigh("ich werde dich nicht töten") == 0 < weigh("je vais tuer vous")
    assert weigh("a calm day") == 0
    assert weigh("x " * 50_000 + "you idiot") == weigh("you idiot")


def test_labels_that_clash_and_repeat(spark):
    docs = spark.createDataFrame([(i, f"{chr(97 + i // 26) * 3}{chr(97 + i % 26) * 2} alpha bad" + "xyz" * (i % 2)) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(1, 0), (1, 0), (3, None), (500, 1)], "doc_id long, toxic int")
    model = tox.fit(docs, labels)
    got = {r.doc_id: r.score for r in tox.score(docs.unionByName(docs.limit(3)), model).collect()}
    assert min(got[i] for i in got if i % 2) > max(got[i] for i in got if i % 2 == 0)
