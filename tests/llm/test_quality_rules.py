"""Counts and verdicts of the quality rules against a plain Python count."""

import random
import re
from collections import Counter

from spendcode.llm.quality_rules import RULES, STOP_WORDS, measures, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {p for i, w in enumerate(windows) if often[w] > 1 for p in (i, i + 1, i + 2)}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside), "n_lines": len(lines),
            "n_stop_words": sum(w.translate(lower) in STOP_WORDS for w in words)}


def measured(docs_frame, texts):
    rows = quality_rules(docs_frame(list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    return {r["doc_id"]: r for r in rows}


def agree(got, texts):
    for i, t in enumerate(texts):
        want = brute(t)
        assert {k: got[i][k] for k in want} == want, (i, (t or "")[:200])
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert got[i]["base_failed"] is failed
        assert not (failed and got[i]["kept"])


def test_odd_texts(docs_frame):
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", "a b", "a b c", "a b c a b c", "a a a a", "a a a", "x y z w x y z w x y",
             "a b c d a b c e b c d", "# * $ % & | < > ### a", "l\nl\nl\r\nl\n\n \n", "\U0001F600 \U0001F600 \U0001F600 \U0001F600", "ab c abc a bc",
             "w1 w2 w3 " * 3 + "\n- x\n- y...\n• z..."]
    agree(measured(docs_frame, texts), texts)


def test_random_texts(docs_frame):
    rng = random.Random(5)
    texts = ["".join(rng.choice(("a", "b", "c ", "\n", " d", "#", "É ", "\t", "the ")) for _ in range(rng.randrange(400))) for _ in range(300)]
    agree(measured(docs_frame, texts), texts)


def test_very_long_text_and_very_long_word(docs_frame):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(40_000)}" for _ in range(200_000)), "ab " * 100_000, "x" * 1_000_000]
    agree(measured(docs_frame, texts), texts)


def test_each_rule_rejects_its_own_text_and_clean_text_stays(docs_frame):
    rng = random.Random(7)
    nouns = [f"{a}{b}{c}" for a in "bdfgklm" for b in ("ata", "elo", "iru") for c in ("n", "ks", "lor")]

    def prose(n=120):
        return [rng.choice(("the", "of", "and", "is")) if rng.random() < 0.25 else rng.choice(nouns) for _ in range(n)]

    def lines(words, size=12):
        return "\n".join(" ".join(words[i:i + size]) + "." for i in range(0, len(words), size))

    one = prose(10)
    texts = {
        "": lines(prose()), "too_short": lines(prose(49)), "repetitive": lines(one * 12),
        "word_length": " ".join("a" if w in STOP_WORDS else w for w in [x for p in prose(400) for x in (p[:1], "the", p[:2], p[:1])]),
        "symbols": lines([w + "##" for w in prose()]) + " the of and in that is was to with" * 3,
        "stop_words": lines([w for w in prose(600) if w not in STOP_WORDS]),
        "wordless": lines([x for w in prose() for x in (w, str(rng.randrange(10**6)))] + ["the"] * 4),
        "capitals": lines([w.upper() for w in prose()]),
        "same_lines": "\n".join([" ".join(prose(20))] * 2 + ["the end"] * 9 + [" ".join(prose(90))]),
        "bullets": "\n".join("- " + " ".join(prose(9)) for _ in range(20)),
        "cut_lines": "\n".join(" ".join(prose(9)) + " ..." for _ in range(20)),
    }
    assert set(texts) == {""} | {r.name for r in RULES}
    got = measured(docs_frame, list(texts.values()))
    for i, name in enumerate(texts):
        assert got[i]["kept"] is (name == "")
        assert name in got[i]["failed"].split(",")


def test_repeated_rows_empty_table_and_other_rules(docs_frame):
    got = quality_rules(docs_frame([(1, "a b"), (1, "a b"), (None, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in got) == [(0, 0, False), (1, 2, False), (1, 2, False)]
    assert quality_rules(docs_frame([])).count() == 0
    assert [r["kept"] for r in quality_rules(docs_frame([(1, "a b")]), rules=()).collect()] == [True]


def test_runs_without_user_functions_and_shuffles(docs_frame):
    plan = measures(docs_frame([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
