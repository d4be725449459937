"""Spans that lie across chunks of letters and anywhere in long stretches."""

import numpy as np
import pytest

from kinlink.llm import pii


@pytest.mark.parametrize("span", ["GB29 NWBK 6016 1331 9268 19", "NL91 ABNA 0417 1643 00"])
def test_iban_with_bank_code(span):
    text = f"please pay to IBAN {span} today"
    at = text.index(span)
    assert pii.find_spans(text, pii.trained()) == ([], [("iban", at, at + len(span))])


@pytest.mark.parametrize("lead", range(380, 404))
@pytest.mark.parametrize("sep", [" ", ","])
def test_no_border_in_long_stretches(lead, sep):
    """Wherever an SSN lies in a row of short numbers, with or without blanks."""
    head = (f"1{sep}2{sep}" * 200)[:lead].rstrip(sep) + sep
    text = f"{head}123-45-6789{sep}7{sep}8"
    assert ("ssn", len(head), len(head) + 11) in pii.find_spans(text, pii.trained())[1]


def every_parse(text, field):
    """All ways to cut a text's tokens into segments, single ones also outside, with their scores."""
    tokens, ends = pii.lattice(text, 0, len(text))
    score = {(i, j): field.weights[[field.index[f] for f in names if f in field.index]].sum(axis=0) for j, own in enumerate(ends) for i, names in own}

    def parses(i):
        if i == len(tokens):
            yield 0.0, []
        for (a, j), s in score.items():
            if a == i:
                for rest, spans in parses(j + 1):
                    for k in range(0 if a == j else 1, len(pii.KINDS) + 1):
                        yield s[k] + rest, ([(pii.KINDS[k - 1], tokens[a][0], tokens[j][1])] if k else []) + spans

    return list(parses(0))


@pytest.mark.parametrize("text", ["tel 55-12", "+4 (1) 2", "a@b.c 1", "7 7 7-7"])
def test_the_program_finds_the_best_parse(text):
    field = pii.trained()
    score, spans = max(every_parse(text, field), key=lambda x: x[0])
    assert field.decode(text, 0, len(text)) == spans


def test_a_step_follows_the_gradient_of_the_likelihood():
    """One small step of training against finite differences of the log likelihood by enumeration."""
    text, gold = "tel 55-12 x", [("phone", 4, 9)]
    field = pii.Field()
    field.fit([(text, gold)], epochs=1, rate=1e-6, decay=0.0)
    step, field.weights = field.weights / 1e-6, np.zeros_like(field.weights)

    def likelihood():
        every = every_parse(text, field)
        return next(s for s, spans in every if spans == gold) - np.logaddexp.reduce([s for s, _ in every])

    start = likelihood()
    for name in ("bias", "cue=phone", "shape=9-9", "digits=4", "tokens=1"):
        for k in range(len(pii.KINDS) + 1):
            f = field.index[name]
            field.weights[f, k] = 1e-5
            assert (likelihood() - start) / 1e-5 == pytest.approx(step[f, k], abs=2e-3)
            field.weights[f, k] = 0


#: Sentences that no generator wrote; what lies between braces is to be found.
WRITTEN = """
You can reach Maria at {maria.lopez@example.org} or on {+34 612 345 678} after five.
Call the desk: {(212) 555-0187}, extension is on the door.
His number was {212-555-0143}; he never answered.
Rufen Sie mich bitte unter Telefon {0171 2345678} an.
Mon fixe est le {01 42 68 53 00}, merci.
tel. {020 7946 0958}
mobile {07700 900123}, office {+44 20 7946 0018}
Fax {555.867.5309} still works.
The SSN on the form, {078-05-1120}, was cancelled long ago.
social security {219-09-9999}
ssn: {457-55-5462}
Please wire it to IBAN {GB82 WEST 1234 5698 7654 32} this week.
Konto {DE89 3704 0044 0532 0130 00} bei der Bank
compte {FR14 2004 1010 0505 0001 3M02 606}
cuenta {ES9121000418450200051332}
account {NL91ABNA0417164300} is closed
{IT60 X054 2811 1010 0000 0123 456}
Visa {4111 1111 1111 1111} expires soon.
My amex is {3782 822463 10005}.
mastercard {5500-0000-0000-0004}
credit card {371449635398431}
server {192.168.10.24} is down, ask {root@db7.example.net}
"""
NOTHING = """
The meeting is on 2024-03-15 at 10:30 in room 4.
In 1998 it sold 1,250,000 copies, up 12.5 percent.
ISBN 978-3-16-148410-0, page 233
version 2.14.1 of the library
item 8834 costs 19.99, or 3 for 50.00
Order no 20231105 left on 05/11/2023.
commit 9fceb02d0ae598e95dc970b74767f19372d61af8
He ran 100 m in 10.2 s and 200 m in 20.9 s.
The score was 3 - 1 after 90 minutes.
Section 12 4 7 of the act of 1934
"""


def test_written_sentences():
    found = wanted = extra = 0
    for line in WRITTEN.strip().splitlines():
        pieces = line.replace("}", "{").split("{")
        text = "".join(pieces)
        want, at = set(), 0
        for k, p in enumerate(pieces):
            if k % 2:
                want.add((at, at + len(p)))
            at += len(p)
        own, more = pii.find_spans(text, pii.trained())
        got = {(a, b) for _, a, b in own + more}
        found, wanted, extra = found + len(got & want), wanted + len(want), extra + len(got - want)
    assert found / wanted >= 0.9 and extra / wanted <= 0.1
    assert sum(len(sum(pii.find_spans(line, pii.trained()), [])) for line in NOTHING.strip().splitlines()) <= 1
