"""Hand-written licence signatures: each with its own text; suppression against a plain version."""

import random

import pytest

from cipherledger.llm import licenses
from cipherledger.llm.license_rules import rules
from cipherledger.llm.license_signatures import SIGNATURES

RULES = {r.name: r for r in rules()}


def test_rules_have_names_of_their_own():
    assert len(RULES) == len(rules()) > 450


@pytest.mark.parametrize("signature", SIGNATURES, ids=lambda s: s[0])
def test_each_signature_finds_its_text(signature):
    name, label, gate, kind, _, text = signature
    lower = text.encode().lower()
    rule = RULES[f"{kind}:{name}"]
    matches = list(rule.pattern.finditer(b" ".join(licenses.WORD.findall(lower))))
    assert matches and rule.label == label
    for match in matches:
        assert gate.encode() in match.group() and any(s in match.group() for s in licenses.SIEVE)
    # among prose of its own, the place is found whole, by this rule or by one that contains it
    (start, end), around = _words(matches[0], lower), b"plain words before. "
    found = licenses.detect(around + lower + b" and after")
    assert any(s <= start + 3 and e >= end + 3 and r.priority >= rule.priority for s, e, r in found)


def _words(match, lower):
    before = match.string[: match.start()].count(b" ")
    return before, before + match.group().count(b" ")


def plain_resolve(found):
    """Each detection against all that outrank it."""
    kept, suppressing = [], []
    for d in sorted(found, key=lambda d: (-d[2].priority, -(d[1] - d[0]), d[0], d[2].name)):
        inside = any(s <= d[0] and e >= d[1] for s, e, _ in suppressing)
        if d[2].name.startswith("base:") or not inside:
            kept.append(d)
        suppressing.append(d)
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].name))


def test_suppression_equals_the_plain_version():
    rng, some = random.Random(5), [r for r in rules() if r.name.startswith(("base:", "dual:", "notice:", "text:"))]
    for size in (0, 1, 2, 5, 20, 80):
        for _ in range(40):
            found = set()
            while len(found) < size:
                start = rng.randrange(size)
                found.add((start, start + rng.randrange(6), rng.choice(some)))
            assert licenses.resolve(list(found)) == plain_resolve(found)


def test_a_text_of_all_signatures_equals_the_plain_version():
    lower = "\n".join(s[5] for s in SIGNATURES).encode().lower()
    line = b" ".join(licenses.WORD.findall(lower))
    every = [(*_words(m, lower), r) for r in rules() if any(g in line for g in r.gates) for m in r.pattern.finditer(line)]
    assert licenses.detect(lower) == plain_resolve(every)
