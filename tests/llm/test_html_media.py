"""Style sheets hide only what they hide on screens."""

import pytest

from lattica.llm import html


@pytest.mark.parametrize(
    "css,shown",
    [
        ("@media print { .x, nav { display:none } }", True),
        ("@media (max-width:600px) { .x{display:none} p{color:red} }", True),
        ("@media screen and (min-width:9px) { .x{display:none} }", True),
        ("@media print { @media screen { .x{display:none} } }", True),
        ("@media screen { .x{display:none} }", False),
        ("@media only screen, print { .x{display:none} }", False),
        ("@media not print { .x{visibility: hidden} }", False),
        ("@import url(a.css); @font-face{font-family:x} .x{display:none}", False),
        ("@supports (display:grid) { .x{display:none} }", False),
        (".y:after{content:'}'} .x{display:none}", False),
        (".x{display:none} .x{display:block}", True),
        (".x{display:block} .x{display:none}", False),
        (".x{display:none !important} .x{display:block}", False),
        ("#i{display:block} .x{display:none}", True),
        ("@media print { .x{display:none} } .x{display:none", False),
    ],
)
def test_rules_apply_on_screens_only(css, shown):
    assert ("seen" in html.extract(f"<style>{css}</style><div class=x id=i>seen</div>end")[1]) == shown


def test_style_attributes_and_media_of_sheets():
    assert "seen" in html.extract("<style media=print>.x{display:none}</style><p class=x>seen</p>")[1]
    assert "seen" in html.extract("<style>.x{display:none}</style><p class=x style='display:block'>seen</p>")[1]
    assert "seen" not in html.extract("<p style='color:red;display:none'>seen</p>")[1]
