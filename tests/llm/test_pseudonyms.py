"""Undoing pseudonyms gives the text back, for mailboxes that look like numbers, bare dates and texts of many kinds."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm.pseudonyms import Pseudonymizer, luhn_digit

KEY = b"key"


def card(r):
    x = "4" + "".join(str(r.randint(0, 9)) for _ in range(14))
    return x + str(luhn_digit(x))


def date(r):
    y, m, d = r.randint(1900, 2099), r.randint(1, 12), r.randint(1, 28)
    return r.choice([f"{y}-{m:02d}-{d:02d}", f"{d}.{m}.{y}", f"{d:02d}.{m:02d}.{y}", f"{m}/{d}/{y}", f"{d}/{m}/{y}", f"{m:02d}/{d:02d}/{y}", f"{d}.{m:02d}.{y}"])


def value(r):
    digits = lambda n: "".join(str(r.randint(0, 9)) for _ in range(n))
    kinds = [
        lambda: card(r),
        lambda: " ".join((c := card(r))[i : i + 4] for i in range(0, 16, 4)) if r else c,
        lambda: date(r),
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        lambda: f"+{r.choice(['1', '44', '420'])} {digits(3)} {digits(3)} {digits(3)}",
        lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: "DE89 3704 0044 0532 0130 00",
        lambda: digits(r.randint(1, 20)),
        lambda: f"{r.choice(['jo.doe', '555-223-4567', '123-45-6789', '10.1.2.3', card(r), date(r).replace('/', '.'), digits(8), 'A1-b2', '%+_'])}@{r.choice(['x.com', 'mail4.example.org', '1.2.3.example.net'])}",
        lambda: r.choice(["word", "v1.2.3", "AB12 3456", "no.", "@", "a@b", "+", "x"]),
    ]
    return r.choice(kinds)()


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 1 << 40))
def test_undo_gives_the_text_back(seed):
    r = random.Random(seed)
    own, back = Pseudonymizer(KEY), Pseudonymizer(KEY, undo=True)
    text = "".join(value(r) + r.choice([" ", ", ", "\n", "; ", ". ", " - "]) for _ in range(r.randint(1, 8)))
    new, found = own.text(text)
    again, same = back.text(new)
    assert again == text and same == found


@pytest.mark.parametrize("name", ["555-223-4567", "123-45-6789", "10.1.2.3", "4111111111111111", "2020-01-22", "+1.555.223.4567", "5.7.2021"])
def test_a_mailbox_is_changed_once(name):
    own, back = Pseudonymizer(KEY), Pseudonymizer(KEY, undo=True)
    new, found = own.text(f"to {name}@x.org now")
    assert found == {"email": 1} and name not in new and new.endswith("@x.org now")
    assert back.text(new)[0] == f"to {name}@x.org now"


def test_a_date_has_one_pseudonym_in_all_layouts():
    own = Pseudonymizer(KEY)
    new = {x: own.text(x)[0] for x in ("2021-07-05", "5.7.2021", "05.07.2021", "7/5/2021", "07/05/2021")}
    y, m, d = new["2021-07-05"].split("-")
    assert new["5.7.2021"] == f"{int(d)}.{int(m)}.{y}" and new["05.07.2021"] == f"{d}.{m}.{y}" and new["7/5/2021"] == f"{int(m)}/{int(d)}/{y}" and new["07/05/2021"] == f"{m}/{d}/{y}"
    assert new["2021-07-05"] != "2021-07-05" and int(d) < 10 and int(m) < 10
