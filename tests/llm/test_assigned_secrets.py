"""Random tokens that follow '=' or are joined to characters of another alphabet."""

import pytest

from skein.llm import secrets

from . import plain_secrets

TOKEN, KEY, URL = "Qm7xT2vR9kLp4sWz8NbY3cHd6Jf1", "wJ8rXUtnFEM/K7MDENGbPxR+iCYzX2MPLq", "q7_Zt-4mKx9Rw2LsVb8Nc3Jh"
CASES = [
    (f"GITHUB_PAT={TOKEN}", TOKEN),
    (f"https://a.example/x?sig={TOKEN}&b=1", TOKEN),
    (f"AWS_ACCESS={KEY}", KEY),
    (f"PAT={TOKEN}== end", f"{TOKEN}=="),
    (f"PAT==x={TOKEN}", TOKEN),
    (f"my-{KEY} end", KEY),
    (f"a/b/{URL} end", URL),
    ("id Qm7xT2vR9kLp4sWz8N== end", "Qm7xT2vR9kLp4sWz8N=="),
]


@pytest.fixture(scope="module")
def found(documents):
    rows = [(k, t) for k, (t, _) in enumerate(CASES)]
    return {r.doc_id: r.spans for r in secrets.report(secrets.scan(documents(rows))).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_token_is_tested_by_itself(found, k):
    text, token = CASES[k]
    at = text.index(token)
    assert f"random:{at}:{at + len(token)}" in found[k].split(",")
    assert found[k] == plain_secrets.brute_report(text)[1]
