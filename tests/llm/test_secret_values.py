"""Novel secrets in KEY=VALUE form."""

import pytest

from lattica.llm import secrets

KEY = "q8ZrT2vLw9XcB4nM7kPd3sHf6jYgA1uE"


@pytest.mark.parametrize("head", ["AWS_SECRET_ACCESS_KEY=", "export AUTH_KEY=", "https://a.example/f?signature=", "pwd=", "--env=SESSION_KEY=", "session = ", "my private NAME=", "cookie=session="])
@pytest.mark.parametrize("tail", ["", "\nnext", "&expires=12"])
def test_values_right_after_their_name_are_found(head, tail):
    text = head + KEY + tail
    assert secrets.scan(text)[1] == [(len(head), 3, len(head) + len(KEY))]


def test_padding_belongs_to_the_value_and_long_names_count():
    assert secrets.scan(f"auth_header={KEY}==")[1] == [(12, 3, 14 + len(KEY))]
    other = "Zx9Qw3LmT7vKp2Rd8YbN4c"
    assert secrets.scan(f"key {other}={KEY}")[1] == [(4, 3, 4 + len(other)), (5 + len(other), 3, 5 + len(other) + len(KEY))]
    assert secrets.scan(f"key\n{KEY}")[1] == []
