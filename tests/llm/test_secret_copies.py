"""Novelty of secrets that stand twice, and of long ones over small alphabets."""

import random

import pytest

from lattica.llm import secrets

KEY = "q8ZrT2vLw9XcB4nM7kPd3sHf6jYgA1uEo5Ki0Vbt"


@pytest.mark.parametrize("gap", [0, 300, 960, 985, 1000, 1100])
def test_both_copies_of_a_secret_are_found(gap):
    line = f"session = {KEY}\n"
    text = line + "x" * gap + "\n" + line
    places = [10, text.rindex(KEY)]
    assert [x for x in secrets.scan(text)[1] if x[1] == 3] == [(a, 3, a + len(KEY)) for a in places]


@pytest.mark.parametrize("length", [40, 64, 80, 96, 128, 256, 3000])
@pytest.mark.parametrize("alphabet", ["0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"])
def test_random_strings_are_novel_at_every_length(length, alphabet):
    r = random.Random(length)
    for _ in range(20):
        key = "".join(r.choice(alphabet) for _ in range(length))
        assert secrets.novelty(key, "some code", "and more") >= secrets.NOVELTY


def test_names_are_explained_by_their_parts():
    name = "user_session_identifier_2024"
    assert secrets.novelty(name, name + " " + name, name) < secrets.NOVELTY
    assert secrets.novelty("private_" * 20 + "1", "", "") < secrets.NOVELTY
