import re

import pytest
from cases import DOCS, counted, docs, prose

from rill.llm import licenses


def brute(rows):
    def runs(text):
        low = (text or "").lower().translate({ord(c): None for c in licenses.STRIPPED})
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"\.+([\x20\x09-\x0D]|$)", r"\1", low))
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    templates = {k: runs(v) for k, v in licenses.TEMPLATES.items()}
    for i, text, _ in rows:
        own = runs(text)
        for k, t in templates.items():
            if len(own & t) >= 0.8 * len(t):
                yield i, k, len(own & t), len(t), len(own & t) / len(t)


@pytest.fixture(scope="module")
def rows():
    out = list(DOCS)
    for n, (_, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        w = text.split()
        out += [(100 + n, f"{prose(n, 40)} {text} {prose(-n, 40)}", "a"), (200 + n, text.upper().replace(" ", "\n"), "a"), (300 + n, text, "b"), (300 + n, text, "b")]
        if len(w) > 30:  # one word changed, and cut in half
            out += [(400 + n, " ".join([*w[:12], "other", *w[13:]]), "a"), (500 + n, " ".join(w[: len(w) // 2]), "a"), (600 + n, f"{' '.join(w[:20])} {prose(n, 9)} {' '.join(w[16:])}", "a")]
    return [*out, (900, "license " * 300, "a"), (901, " ".join(licenses.TEMPLATES.values()), "a"), (902, "licensed under the license", "a"), (903, "Rele(ased) \"under\" the M'IT Li[cen]se...", "a")]


def test_against_all_templates(spark, rows):
    got = licenses.scan(docs(spark, rows)).collect()
    assert counted(got) == counted(brute(rows))
    assert {r.license for r in got} == set(licenses.TEMPLATES)


def test_plan_is_native_and_narrow(spark):
    plan = licenses.scan(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange", "Join"))


def test_words_of_a_template_without_its_runs_are_no_candidates(spark, rows):
    """Only texts that share a run of five words with some template have windows; the plan asks for these places."""
    far = [(i, " ".join(sorted(t.split(), key=len)), "a") for i, t in enumerate(licenses.TEMPLATES.values())]
    assert licenses.scan(docs(spark, far)).count() == 0
    long = [(1, f"{prose(1, 20_000)} {licenses.TEMPLATES['mit-grant']} {prose(2, 20_000)} {licenses.TEMPLATES['zlib']}", "a")]
    assert counted(licenses.scan(docs(spark, long)).collect()) == counted(brute(long))


def test_no_rows_and_no_templates(spark):
    assert licenses.scan(docs(spark, [])).count() == 0
    assert licenses.scan(docs(spark), {}).count() == 0
    with pytest.raises(ValueError, match="five words"):
        licenses.scan(docs(spark), {"short": "two words"})
