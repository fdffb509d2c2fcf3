"""Scorers against an independent dynamic-programming LCS, and the distributed best match
against brute force."""

import random

from pyspark.sql import functions as F

from spendcode.functions import fuzzy as FZ


def dp_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if ca == cb else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


def ref_ratio(a, b):
    if a == b:
        return 100
    if not a or not b:
        return 0
    total = len(a) + len(b)
    return int(round(100 * ((total - (total - 2 * dp_lcs(a, b))) / total)))


def random_strings(n, seed=7, alphabet="abcde fgé_Ł1", max_len=80):
    rnd = random.Random(seed)
    return [("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, max_len))),
             "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, max_len)))) for _ in range(n)]


def test_python_helpers_match_dp():
    for a, b in random_strings(300, max_len=150):
        assert FZ.py_ratio(a, b) == ref_ratio(a, b)
        assert FZ.lcs_length(a, b) == dp_lcs(a, b)


def test_native_and_udf_ratio_match_dp(spark):
    pairs = random_strings(400)
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["s"] for r in FZ.with_ratio(df, "a", "b", "s").collect()}
    assert got == {i: ref_ratio(a, b) for i, (a, b) in enumerate(pairs)}


def test_expression_over_several_words_matches_dp(spark):
    rnd = random.Random(9)
    pairs = []
    for n in (61, 62, 63, 64, 123, 124, 125, 186, 187, 260, 500):
        for _ in range(4):
            a = "".join(rnd.choice("abcdé f中\n") for _ in range(n))
            near = "".join(rnd.choice((ch, ch, ch, "", "x" + ch)) for ch in a)
            pairs += [(a, near), (near, a), (a, a[::-1]), (a, "a" * rnd.choice((63, 124, 400))), (a, a), (a, "q" * 200)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    scored = FZ.with_ratio(df, "a", "b", "s")
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    assert {r["i"]: r["s"] for r in scored.collect()} == {i: ref_ratio(a, b) for i, (a, b) in enumerate(pairs)}


def test_token_sort(spark):
    df = spark.createDataFrame([(0, "small ring", "ring small"), (1, "blue bolt!", "Bolt, BLUE"),
                                (2, "café", "caf"), (3, "!!!", "???"), (4, "abc", "xyz")],
                               "i int, a string, b string")
    df = df.select("i", F.lower("a").alias("a"), F.lower("b").alias("b"))
    got = {r["i"]: r["s"] for r in FZ.with_ratio(df, "a", "b", "s", token_sort=True).collect()}
    assert got == {0: 100, 1: 100, 2: 100, 3: 100, 4: 0}
    plain = {r["i"]: r["s"] for r in FZ.with_ratio(df, "a", "b", "s").collect()}
    assert plain[0] == 50 and plain[4] == 0


def test_token_sort_key_python_equivalence(spark):
    texts = ["The  Acme, Inc.", "blå bær", "Zebra apple_pie", "  ", "ÉCOLE łódź"]
    df = spark.createDataFrame([(i, t.lower()) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(FZ.token_sort_key("t")).collect()]
    assert got == [FZ.py_token_sort_key(t.lower()) for t in texts]


def brute_best(text, catalogue, scorer, cutoff, score=ref_ratio):
    key = (lambda t: FZ.py_token_sort_key(t.lower())) if scorer == "token_sort" else str.lower
    scored = [(score(key(text or ""), key(d)), -o, c, d) for o, c, d in catalogue if d is not None] if (text or "").strip() else []
    best = max(scored, key=lambda x: x[:2], default=(0, 0, None, None))
    return (best[2], best[3], best[0]) if best[0] >= max(1, cutoff or 0) else (None, None, 0)


def test_best_match_equals_brute_force(spark):
    from spendcode.operators.match import attach_best_match
    catalogue = [(5, "c5", "Blue bolt"), (1, "c1", "red widget"), (3, "c3", "bolt blue"), (2, "c2", None),
                 (4, "c4", "Hot gear"), (6, "c6", "?!"), (7, "c7", "small gizmo and a very long name " * 3)]
    texts = ["blue bolt", "BOLT, blue!", "gear hot", "zzz", "  ", None, "!!", "red widgets", "hot",
             "small gizmo", "small gizmo and a very long name " * 3 + "x"]
    cat = spark.createDataFrame(catalogue, "ordinal long, code string, description string")
    lines = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for scorer, cutoff in (("token_sort", None), ("ratio", 70), ("ratio", None)):
        for rows in (500_000, 2):  # one chunk, then several chunks merged with max_by
            got = {r["i"]: (r["m_code"], r["m_description"], r["m_score"])
                   for r in attach_best_match(lines, "t", cat, scorer=scorer, cutoff=cutoff, prefix="m",
                                              max_rows=rows).collect()}
            want = {i: brute_best(t, catalogue, scorer, cutoff) for i, t in enumerate(texts)}
            assert got == want, (scorer, cutoff, rows)


def test_blocks_parts_and_slices_equal_brute_force(spark, monkeypatch):
    """Many pivots, split blocks, several slices and long texts against all pairs."""
    import spendcode.operators.match as M
    monkeypatch.setattr(M, "SLICE_TEXTS", 40)
    monkeypatch.setattr(M, "REFERENCES", 3)
    rnd = random.Random(31)
    nouns = ["bolt", "gear", "ring", "widget", "plate", "gizmo", "nut"]
    name = lambda: " ".join(rnd.choice(nouns) + rnd.choice(("", "s", " m4", " 10mm")) for _ in range(rnd.randint(1, 5)))
    catalogue = [(i * 8 % 301, f"c{i}", rnd.choice((name(), name(), None, "", "?!", name() * 12))) for i in range(301)]
    texts = [name() if rnd.random() < 0.7 else "".join(rnd.choice("abc xyz0") for _ in range(rnd.randint(0, 400))) for _ in range(90)]
    texts += [catalogue[5][2], None, " ", "!!", "BOLT  gear"] + ["hot text"] * 40
    cat = spark.createDataFrame(catalogue, "ordinal long, code string, description string")
    lines = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for scorer, cutoff in (("token_sort", None), ("ratio", 70)):
        want = {i: brute_best(t, catalogue, scorer, cutoff, score=FZ.py_ratio) for i, t in enumerate(texts)}
        for rows, pivots in ((M.PART_ROWS, None), (5, 9), (50, 1)):
            got = {r["i"]: tuple(r)[-3:] for r in M.attach_best_match(lines, "t", cat, scorer=scorer, cutoff=cutoff, max_rows=rows, pivots=pivots).collect()}
            assert got == want, (scorer, cutoff, rows, pivots)


def test_bounds_never_hide_an_entry():
    import numpy as np
    from spendcode.operators.match import _Pivots
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcde ") for _ in range(rnd.randint(0, n)))
    entries = list(dict.fromkeys(text(70) for _ in range(300)))
    pivots = [e[:62] for e in entries[:12]]
    index = _Pivots(pivots)
    d = np.array([index.distances(e) for e in entries])
    assert all(d[i][j] == len(e) + len(p) - 2 * dp_lcs(e, p) for i, e in enumerate(entries[:40]) for j, p in enumerate(pivots))
    blocks = []
    for b in sorted(set(d.argmin(1).tolist())):
        own = d[d.argmin(1) == b][:, [b, 0, 1, 2]]
        lens = [len(e) for e, x in zip(entries, d) if x.argmin() == b]
        blocks.append((b, min(lens), max(lens), 0, 1, own.min(0).tolist(), own.max(0).tolist()))
    index = _Pivots(pivots, blocks)
    place = {b[0]: i for i, b in enumerate(blocks)}
    for t in [text(70) for _ in range(60)] + [text(600) for _ in range(5)] + [rnd.choice(entries) + "a" for _ in range(40)]:
        ub, _ = index.bounds(t)
        for e, x in zip(entries, d):
            assert t == e or ref_ratio(t, e) <= ub[place[int(x.argmin())]]


def test_a_near_text_meets_few_blocks(spark, monkeypatch):
    """Work for a text that has a near entry does not grow with the catalogue: most blocks are ruled out."""
    import spendcode.operators.match as M
    rnd = random.Random(12)
    # families of entries: a stem of words each, with small changes
    stems = [" ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(4)) for _ in range(40)]
    catalogue = [(i, f"c{i}", f"{stems[i % 40]} {i // 40}") for i in range(1600)]
    texts = [(i, f"{stems[i % 40]} x") for i in range(40)]
    seen, scored = [], M._scored
    monkeypatch.setattr(M, "_scored", lambda pairs, entries, slices: seen.append(pairs) or scored(pairs, entries, slices))
    cat = spark.createDataFrame(catalogue, "ordinal long, code string, description string")
    M.attach_best_match(spark.createDataFrame(texts, "i int, t string"), "t", cat, scorer="ratio").collect()
    visits = sum(p.count() for p in seen)
    assert visits <= 0.25 * 40 * 40, visits


def test_ties_go_to_earliest_row(spark):
    from spendcode.operators.match import attach_best_match
    cat = spark.createDataFrame([(9, "late", "abcd"), (2, "early", "abce")], "ordinal long, code string, description string")
    lines = spark.createDataFrame([(0, "abcx")], "i int, t string")
    r = attach_best_match(lines, "t", cat, scorer="ratio", prefix="m").first()
    assert (r["m_code"], r["m_score"]) == ("early", 75)


def test_documents_against_brute_force(spark):
    """Whole document texts (no SQL oracle: cubic in SQL) on the smallest fixture."""
    import __spark_entry__ as E
    from tests.conftest import SF_SMALL
    got = {r["doc_id"]: (r["match_code"], r["match_description"], r["match_score"])
           for r in E.queries()["fuzzy_best_documents"](spark, SF_SMALL).collect()}
    part = spark.read.parquet(f"{SF_SMALL}/part.parquet").select("p_partkey", "p_name").collect()
    catalogue = [(r[0], str(r[0]), r[1]) for r in part]
    # dedupe the catalogue on the normalised name (earliest row), as the job does
    seen, cat = set(), []
    for o, c, d in sorted(catalogue):
        k = FZ.py_token_sort_key(d.lower())
        if k not in seen:
            seen.add(k)
            cat.append((o, c, d))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    for doc_id, text in docs:
        # whole texts of thousands of characters: the bit-parallel helper, which is held against the table above
        assert got[doc_id] == brute_best(text, cat, "token_sort", None, score=FZ.py_ratio), doc_id


def test_numpy_masks_equal_python_masks():
    rnd = random.Random(11)
    for _ in range(50):
        s = "".join(rnd.choice("abcé Ł") for _ in range(rnd.randint(0, 300)))
        full = FZ.char_masks(s)
        assert FZ.char_masks_np(s, "abcé Łz") == full
        other = "".join(rnd.choice("abcé Łz") for _ in range(rnd.randint(1, 20)))
        assert FZ.lcs_with_masks(FZ.char_masks_np(s, set(other)), len(s), other) == dp_lcs(s, other)


def test_chunk_scan_equals_brute_force_random():
    """The per-task scan (bounds, early exit, vectorised LCS) against brute force."""
    from spendcode.operators.match import _Catalogue, best_in_chunk
    rnd = random.Random(21)
    alphabet = "abcdeé f"
    for trial in range(30):
        n = rnd.randint(1, 120)
        entries = []
        for i in range(n):
            L = rnd.choice([0, rnd.randint(1, 12), rnd.randint(1, 40), rnd.randint(60, 90)])
            entries.append(("".join(rnd.choice(alphabet) for _ in range(L)), i * 3 + rnd.randint(0, 2), f"c{i}", "d"))
        entries.sort(key=lambda e: e[1])
        cat = _Catalogue(entries)
        for _ in range(15):
            t = "".join(rnd.choice(alphabet + "xyz") for _ in range(rnd.choice([0, 3, 10, 35, 70, 200])))
            for floor in (1, 70):
                best, best_o = floor - 1, None
                for key, o, _, _ in entries:
                    s = FZ.py_ratio(t, key)
                    if s > best or (s == best and best_o is not None and o < best_o):
                        best, best_o = s, o
                got = best_in_chunk(cat, t, floor)
                want = None if best_o is None else (best_o, best)
                assert (None if got is None else (entries[got[0]][1], got[1])) == want, (trial, t, floor)


def test_chunk_scan_large_alphabet(monkeypatch):
    """Bag bound with an 'other' bucket and no masks (large alphabet) stays exact."""
    import spendcode.operators.match as M
    monkeypatch.setattr(M, "BAG_CHARS", 3)
    monkeypatch.setattr(M, "MASK_CHARS", 4)
    rnd = random.Random(5)
    alphabet = "abcdefghij "
    entries = sorted((("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))), i, f"c{i}", "d")
                      for i in range(80)), key=lambda e: e[1])
    cat = M._Catalogue(entries)
    assert not cat.vector_ok
    for _ in range(60):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
        best, best_o = 0, None
        for key, o, _, _ in entries:
            s = FZ.py_ratio(t, key)
            if s > best or (s == best and best_o is not None and o < best_o):
                best, best_o = s, o
        got = M.best_in_chunk(cat, t, 1)
        assert (None if got is None else (entries[got[0]][1], got[1])) == (None if best_o is None else (best_o, best))


def test_slice_scan_scores_long_entries_side_by_side(monkeypatch):
    """Texts of a slice at once, entries of one to four mask words and more, against brute force; none of up to
    four words is scored alone."""
    import spendcode.operators.match as M
    rnd = random.Random(3)
    alphabet = "abcdeé f"
    alone, one = [], M._Catalogue.lcs_one
    monkeypatch.setattr(M._Catalogue, "lcs_one", lambda self, text, j, masks: alone.append((len(text), len(self.keys[j]))) or one(self, text, j, masks))
    word = lambda n, more="": "".join(rnd.choice(alphabet + more) for _ in range(n))
    for n in (1, 2, 8, 9, 64, 65, 200):
        lengths = (0, 5, 30, 63, 64, 70, 126, 127, 200, 252, 253, 300)
        entries = [(word(rnd.choice(lengths)), i * 3, f"c{i}", "d") for i in range(n)]
        cat = M._Catalogue(entries)
        texts = [word(rnd.choice((0, 3, 10, 35, 70, 200, 256, 257, 600)), "xyz") for _ in range(20)] + [entries[0][0]]
        floors = [rnd.choice((1, 55, 70)) for _ in texts]
        for text, floor, got in zip(texts, floors, M.best_in_slice(cat, texts, floors)):
            best, at = floor - 1, None
            for j, e in enumerate(entries):
                s = FZ.py_ratio(text, e[0])
                if s > best:
                    best, at = s, j
            assert got == (None if at is None else (at, best)), (n, text, floor)
    assert all(text > M.VECTOR_MAX_TEXT or entry > 252 for text, entry in alone)


def test_texts_move_only_to_where_they_are_scored(spark, monkeypatch):
    """Candidates and winners carry numbers for the texts, and a filter on blank texts computes no key."""
    import spendcode.operators.match as M
    moved, winners, read, settle = [], M._winners, [], M.settle
    monkeypatch.setattr(M, "_winners", lambda found: moved.append(found.columns) or winners(found))
    monkeypatch.setattr(M, "settle", lambda df, name: read.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or settle(df, name))
    catalogue = [(i, f"c{i}", f"{w} bolt") for i, w in enumerate(("red", "blue", "long", "red"))]
    texts = ["Red bolt!", "red bolt", None, " ", "bolt", "a long text of blue bolts " * 40, "?!"] * 2
    cat = spark.createDataFrame(catalogue, "ordinal long, code string, description string")
    lines = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: tuple(r)[-3:] for r in M.attach_best_match(lines, "t", cat).collect()}
    assert got == {i: brute_best(t, catalogue, "token_sort", None, score=FZ.py_ratio) for i, t in enumerate(texts)}
    assert moved and not any("k" in columns for columns in moved)
    result = M.best_matches(lines.select(F.lower("t").alias("k")).where("k is not null").distinct(), cat)._jdf.queryExecution().optimizedPlan().toString()
    by_id = [x for x in result.splitlines() if "Join" in x and "(id#" in x]
    assert by_id and all("strategy=merge" in x for x in by_id), result  # what grows with the texts is not broadcast
    plan = next(p for name, p in read if name == "match-texts")
    assert plan.count("sort_array(") == 1, plan  # the key is made once, and its words are sorted without a comparator


def test_token_sort_key_equals_python_helper(spark):
    rnd = random.Random(41)
    texts = ["".join(rnd.choice("abZ é\u00a0\u0141_-  \t\n9\U0001F600") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", FZ.token_sort_key(F.lower("t")).alias("k")).collect()
    assert all(r["k"] == FZ.py_token_sort_key(r["t"].lower()) for r in rows)
