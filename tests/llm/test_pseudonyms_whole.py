"""Personal data that once stayed in clear."""

import re

import pytest

from sessile.llm import pseudonyms

SAME = {
    'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"': r'TOKEN = "[0-9A-F]{40}"',
    "Api_Key: ABCDEFAB": r"Api_Key: [0-9A-F]{8}",
    "PASSWORD=zk49vX_aa1": r"PASSWORD=[a-z]{2}\d\d[a-z][A-Z]_[a-z]{2}\d",
    "+1 (017) 555-7713": r"\+1 \(\d{3}\) \d{3}-\d{4}",
    "+1 (132) 555-1352": r"\+1 \(\d{3}\) \d{3}-\d{4}",
    "+1 (432) 055-1352": r"\+1 \(\d{3}\) \d{3}-\d{4}",
    "+1 234 5678": r"\+1 \d{3} \d{4}",
    "12/25/1990": r"(0\d|1[0-2])/(1[3-9]|2\d|3[01])/(19|20)\d\d",
    "March 12, 2020": r"[A-Z][a-z]+ [1-9]\d?, (19|20)\d\d",
    "March 05, 2020": r"[A-Z][a-z]+ 0[1-9], (19|20)\d\d",
}


@pytest.mark.parametrize("value", SAME)
def test_found_and_undone(value):
    for key in (b"k", b"l", b"m", b"n", b"o", b"p"):
        f = pseudonyms.Feistel(key)
        new, spans = pseudonyms.replace(f"x {value} y", f)
        assert len(spans) == 1 and value not in new and re.fullmatch(SAME[value], new[2:-2])
        assert pseudonyms.replace(new, f, True)[0] == f"x {value} y"


def test_upper_and_lower_case_of_a_secret_stay_linked():
    f = pseudonyms.Feistel(b"k")
    low = pseudonyms.replace('token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"', f)[0]
    assert pseudonyms.replace('TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"', f)[0] == low.upper()


@pytest.mark.parametrize("letters", ["ABCDEFAB", "A0000001", "0000000F"])
def test_upper_case_pseudonyms_show_their_case(letters):
    for k in range(300):
        f = pseudonyms.Feistel(b"%d" % k)
        new = pseudonyms.replace(f"SECRET={letters}", f)[0]
        assert not new[7:].isdigit() and pseudonyms.replace(new, f, True)[0] == f"SECRET={letters}"


@pytest.mark.parametrize("text", ["13/32/1990", "February 30, 2020", "017-555-7713", "a tokenised text"])
def test_no_value(text):
    assert pseudonyms.replace(text, pseudonyms.Feistel(b"k")) == (text, [])
