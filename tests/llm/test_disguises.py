import random
import time

import pytest

from pitchside.llm import pii


@pytest.mark.parametrize(
    "address",
    [
        "jane.doe [at] example dot com",
        "jane.doe@example dot com",
        "jane.doe at example [dot] com",
        "jane.doe at mail.example dot com",
        "jane.doe＠example dot photography",
        "jane(at)firm dot dev",
        "jane at firma dot pl",
        "jane at firm dot dev",
        "jane.doe at example dot photography",
        "jane dot doe at example.com",
    ],
)
def test_mixed_disguises_and_other_endings(address):
    text = f"Write to us: {address}, or call."
    assert address in [text[s:e] for s, e in pii.find(text)[1]["email"]]


@pytest.mark.parametrize("text", ["look at example.com", "we met at ten. dot org is an ending", "stare at the dot to the left", "look at this dot matrix", "pies @ shop.com", "@example dot com"])
def test_prose_is_left_alone(text):
    assert pii.joined(pii.find(text)[1]) == ""


def test_address_ends_where_its_domain_does():
    text = "jane at firm dot com dot however, and bob at firma dot pl."
    assert [text[s:e] for s, e in pii.find(text)[1]["email"]] == ["jane at firm dot com", "bob at firma dot pl"]
    text = "mail bob@firm.com dot matrix"
    assert [text[s:e] for s, e in pii.find(text)[1]["email"]] == ["bob@firm.com"]


DIGITS = "zero one two three four five six seven eight nine".split()
LOOK = {latin: other for other, latin in pii.LOOKALIKES.items()}


def shifted(zero):
    return lambda s: "".join(chr(zero + int(c)) if c.isdigit() else c for c in s)


def card(r):
    body = "4" + "".join(str(r.randrange(10)) for _ in range(14))
    return next(body + str(d) for d in range(10) if pii.luhn(body + str(d)))


MAKE = {
    "email": lambda r: f"{r.choice(['jane', 'bob', 'mia', 'omar'])}.{r.choice(['doe', 'roe', 'poe'])}@{r.choice(['mail', 'firm', 'uni'])}.{r.choice(['example', 'sample'])}.{r.choice(['com', 'org', 'de', 'museum'])}",
    "ip": lambda r: ".".join(str(r.randrange(256)) for _ in range(4)),
    "card": card,
    "phone": lambda r: f"+{r.randrange(1, 10)}{r.randrange(10)} {r.randrange(100, 1000)} {r.randrange(1000, 10000)}",
}
HIDE = {
    "full-width": ("email ip card phone", lambda s: "".join(chr(ord(c) + 0xFEE0) if c.isalnum() or c in "@.+" else c for c in s)),
    "Bengali digits": ("ip card phone", shifted(0x9E6)),
    "mathematical digits": ("ip card phone", shifted(0x1D7CE)),
    "invisible characters": ("email ip card phone", lambda s: "​".join(s)),
    "look-alikes": ("email", lambda s: "".join(LOOK.get(c, c) for c in s)),
    "ideographic dots": ("email ip", lambda s: s.replace(".", "。")),
    "brackets": ("email", lambda s: s.replace("@", " [at] ").replace(".", " [dot] ")),
    "spoken": ("email", lambda s: s.replace("@", " at ").replace(".", " dot ")),
    "spelled digits": ("card ip phone", lambda s: " ".join(DIGITS[int(c)] if c.isdigit() else {"+": "plus", ".": "dot"}[c] for c in s if c != " ")),
}


@pytest.mark.parametrize("name", HIDE)
def test_recall_of_each_disguise(name):
    """At least nine of ten of 200 identifiers of every kind are found, with their source offsets."""
    kinds, hide = HIDE[name]
    for kind in kinds.split():
        r, caught = random.Random(name + kind), 0
        for _ in range(200):
            hidden = hide(MAKE[kind](r))
            before = r.choice(["Please write to ", "It was ", "Ask for ", "Über "])
            text = before + hidden + r.choice([", thanks", "; or not", "\nnext line", " (as said)"])
            caught += (len(before), len(before) + len(hidden)) in pii.find(text)[1][kind]
        assert caught >= 180, (kind, caught)


def test_digits_of_any_script_need_no_other_sign():
    assert pii.joined(pii.find("ip ১৯২.১৬৮.১.১ x")[1]) == "ip:3:14"
    assert pii.joined(pii.find("ip 𝟏𝟗𝟐.𝟏𝟔𝟖.𝟏.𝟏 x")[1]) == "ip:3:14"
    assert pii.joined(pii.find("x² + y³ = ½ of 10¹⁶")[1]) == ""


def test_long_texts_take_linear_time():
    text = "one two " * 60_000 + "jane at " * 60_000 + "dot x " * 60_000 + "[at] " * 60_000 + "１" * 200_000
    began = time.time()
    pii.find(text)
    half = time.time() - began
    began = time.time()
    pii.find(text * 2)
    assert time.time() - began < 5 * half + 2
