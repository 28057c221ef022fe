"""Base spans against the contract's patterns verbatim, and the field on sentences that its table did not make."""

import hashlib
import re

import numpy as np
import pytest

from bytemill.llm import pii
from bytemill.llm.queries import op9_personal_data

# The patterns as they are specified.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    total = 0
    for i, d in enumerate(int(c) for c in digits[::-1]):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def brute(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    keep = {
        "email": (EMAIL, lambda m: True),
        "ip": (IP, lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (CARD, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (PHONE, lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [(kind, m.start(), m.end()) for kind, (pattern, ok) in keep.items() for m in re.finditer(pattern, text) if ok(m)]


def test_query_against_the_patterns(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id")
    rng = np.random.default_rng(5)
    made = ["".join(rng.choice(list("0159.+-@ ()aé😀"), 60)) for _ in range(300)] + ["4111-1111 1111 1111 4111111111111111", "a@b.c.d@e.f @g.h i@j", "1.2.3.4.5.6.7.8", "+1 (2) 3.4-5678 9+1234567", None, ""]
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(made)], "doc_id long, text string")
    docs.select("doc_id", "text").unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet")).collect()
    got = {r.doc_id: r for r in op9_personal_data(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) == 1000 + len(made)
    for r in rows:
        want, out = brute(r.text or ""), got[r.doc_id]
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert out.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [out[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in want) for k in ("email", "ip", "card", "phone")]
        spans = [tuple(x.rsplit(":", 2)) for x in out.spans.split(",") if x]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(out.spans.split(",")) or not want
        assert len(spans) == len(want) + out.n_added and all(0 <= int(a) < int(b) <= len(r.text or "") for _, a, b in spans)


#: Written by hand: what stands between | is personal.
PRIVATE = [
    "Please write to |jane [at] shop [dot] org| before Friday.", "You can reach me under |(415) 555-2671| after six.", "Meine Nummer ist |030 1234567|, bitte rufen Sie an.", "Appelez le |01 42 68 53 00| demain matin.",
    "Mi tarjeta es |4539 1488 0343 6468| y vence pronto.", "The amex |3782 822463 10005| was declined.", "His ssn |078-05-1120| was printed on the card.", "Server at |10.0.0.12:8080| answered slowly.", "mail me: |bob(at)example.com|",
    "Kontakt: |anna [at] firma [dot] de|", "call |555-867-5309| now", "Tel. |+44 20 7946 0958|", "pay with card |4111 1111 1111 1112| today", "contact |(212) 555-0199| or |212.555.0188|", "Her number is |123-45-6789|.",
]
PLAIN = [
    "In 2019 the city had 1,204,500 people and 35 schools.", "The order 9807915762804490 was shipped on 2021-03-04.", "Version 3.11.4 fixes 12 bugs, see page 120.", "At 10:30 the train to Platform 9 leaves, 45 minutes late.",
    "Der Umsatz stieg um 12,5 % auf 3.400.000 Euro im Jahr 2020.", "Le score final était 102 à 98 après 48 minutes.", "El 15/08/1997 llegaron 300 personas.", 'token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"',
    "chapter 4, lines 100 200 300 and 400", "The (old) house [see note 12] cost $450 in 1899.", "ISBN 978 3 16 148410 0 is in stock", "x = 1234 5678",
]


def test_recall_and_precision_on_sentences_written_by_hand():
    decoder = pii.Decoder(pii.trained())

    def found(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return {data[a:b].tobytes().decode() for _, _, a, b in decoder.spans(data, np.array([0, len(data)]))}

    wanted = [(t.replace("|", ""), t.split("|")[1::2]) for t in PRIVATE]
    hits = sum(x in found(t) for t, spans in wanted for x in spans)
    wrong = sum(len(found(t) - set(spans)) for t, spans in wanted) + sum(len(found(t)) for t in PLAIN)
    assert hits >= 13 and wrong <= 2, (hits, wrong)


def test_spans_of_texts_with_wide_characters_and_many_base_spans(spark):
    text = "é😀 " * 3000 + "call (415) 555-2671 now\n" + "a@b.c " * 4000 + "漢字 contact jane [at] shop [dot] org"
    row = pii.find_personal(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.kind, text[s.start : s.end]) for s in row.added] == [("email", "jane [at] shop [dot] org"), ("phone", "(415) 555-2671")]
    assert len(row.base) == 4000


@pytest.mark.parametrize("word", ["x" * 100_000, "9" * 100_000, "a1" * 50_000, "[at]" * 20_000])
def test_long_words(word):
    data = np.frombuffer(f"call {word} (415) 555-2671".encode(), np.uint8)
    spans = list(pii.Decoder(pii.trained()).spans(data, np.array([0, len(data)])))
    assert all(0 <= a < b <= len(data) for _, _, a, b in spans)


def test_digests_and_numbers_without_a_cue_stay_out():
    rng, decoder = np.random.default_rng(8), pii.Decoder(pii.trained())
    digits = lambda n: "".join(rng.choice(list("0123456789"), n))
    decoys = []
    for k in range(300):
        number = next(x for x in iter(lambda: digits(16), None) if not luhn(x))
        decoys += [f'the word. token = "{rng.bytes(20).hex()}" and then', f"Onto !! WORD!! {number} !! NEXT!! word", f"a line of words {number} goes on. It ends"]
    data = np.frombuffer("\n".join(decoys).encode(), np.uint8)
    assert len(list(decoder.spans(data, np.array([0, len(data)])))) <= 9  # 1 %
