"""Every license rule on a text of its own and on one that misses a word, and the whole scan against plain Python."""

import re
import re._parser as parser

import pytest

from retail_spark.llm import licenses
from retail_spark.llm.licenses import RULES, SILENCE


def sample(tokens):
    """A text that a pattern matches: first alternatives, optional parts left out, as few repeats as may be."""
    out = ""
    for op, value in tokens:
        name = str(op)
        if name == "LITERAL":
            out += chr(value)
        elif name == "NOT_LITERAL":
            out += "w"
        elif name == "IN":
            kind, x = value[0]
            out += "w" if str(kind) == "NEGATE" else chr(x[0] if str(kind) == "RANGE" else x)
        elif name == "BRANCH":
            out += sample(value[1][0])
        elif name == "SUBPATTERN":
            out += sample(value[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += sample(value[2]) * value[0]
        else:
            raise ValueError(name)
    return out


SAMPLES = [re.sub(" +", " ", sample(parser.parse(r.pattern))).strip() for r in RULES]


def plain(text):
    """(label, start, end) of what the rules leave, gate, match and containment one after another."""
    lower = text.lower()
    words = " " + re.sub(licenses.BETWEEN, " ", text).strip(" ") + " "
    found = []
    for i, r in enumerate(RULES):
        if r.root in lower and r.key in lower:
            for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", words, re.IGNORECASE | re.ASCII):
                start = words[: m.start()].count(" ") - 1
                found.append((start, -(start + 1 + m[0].count(" ")), -r.priority, i, r.label))
    found.sort()
    kept = []
    for k, (start, end, priority, _, label) in enumerate(found):
        if -priority < SILENCE and not any(-e >= -end and -p >= -priority for _, e, p, _, _ in found[:k]):
            kept.append((label, start, -end))
    return kept


@pytest.fixture(scope="module")
def scan(spark):
    def run(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
        rows = {r.doc_id: r.found for r in licenses.license_report(df).collect()}
        return [[(f.rsplit(":", 2)[0], *map(int, f.rsplit(":", 2)[1:])) for f in rows[i].split(",") if f] for i in range(len(texts))]

    return run


def gate(rule):
    return f"{rule.root} {rule.key}"


def test_rules_are_many_and_written_by_hand():
    wordings = [r for r in RULES if r in licenses.WORDINGS]
    assert len(wordings) > 95 and len({r.pattern for r in RULES}) > 480
    for r, text in zip(RULES, SAMPLES, strict=True):
        assert re.fullmatch(r.pattern, text), (r, text)


def test_every_rule_finds_its_text(scan):
    texts = [f"{gate(r)} . {t} . end" for r, t in zip(RULES, SAMPLES, strict=True)]
    found = scan(texts)
    assert found == [plain(t) for t in texts]
    for r, t, spans in zip(RULES, SAMPLES, found, strict=True):
        if r.priority < SILENCE:
            start = len(re.findall(licenses.WORD, gate(r)))
            end = start + len(t.split())
            covers = [x for x in spans if x[1] <= start and x[2] >= end]
            assert covers, (r, spans)  # itself, or a rule that holds it


def test_no_rule_finds_a_text_that_lacks_a_word(scan):
    """The middle word of every sample is another one: what is found now lies beside it."""
    texts, places = [], []
    for r, t in zip(RULES, SAMPLES, strict=True):
        words = t.split()
        words[len(words) // 2] = "qqqq"
        texts.append(f"{gate(r)} . {' '.join(words)} . end")
        places.append(len(re.findall(licenses.WORD, gate(r))) + len(words) // 2)
    found = scan(texts)
    assert found == [plain(t) for t in texts]
    for r, place, spans in zip(RULES, places, found, strict=True):
        if "[^ ]" not in r.pattern and "[a-z]" not in r.pattern:
            assert not any(start <= place < end and label == r.label for label, start, end in spans), (r, spans)


def test_talk_of_a_license_is_silenced(scan):
    talk = [
        "This work is not licensed under the Apache License, Version 2.0.",
        "Unlike the GNU General Public License, it asks for nothing.",
        "It uses the ISC text instead of the MIT License.",
        "The history of the Mozilla Public License 2.0 is long.",
        "The song is not in the public domain.",
        "His driver's license was gone.",
    ]
    assert scan(talk) == [[]] * len(talk)
    assert [x[0][0] for x in scan(["Licensed under the Apache License, Version 2.0.", "It is in the public domain."])] == ["apache-2.0", "public-domain"]


def test_the_scan_equals_plain_python_over_the_test_table(spark, scan):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = scan(texts)
    assert found == [plain(t) for t in texts] and sum(map(len, found)) > 30
