"""Url filter, license scan and line dedup against brute force."""

import random
import re

from spendcode.llm import license_scan, line_dedup, url_filter
from spendcode.llm.url_filter import Rule


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_urls_match_brute_force(spark):
    rng = random.Random(8)
    hosts = ["a.net", "NET", "example.net", "www.Example.net", "x.org", "notexample.net", "b.example.com", "example.com", "fr.org", "net.x"]
    paths = ["", "/", "/en/1", "/de/", "/de", "/fr/x?y=/de/", "#/en/", "?a", "/EN/"]
    rules = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"),
             Rule("allow", "org", "/fr/")] + [Rule(rng.choice(["allow", "block"]), f"h{i}.org", "/p") for i in range(80)]
    urls = [None, "", "no scheme", "http://", "x://a://b.net/", "http://é.net/"] + [
        f"https://{h}{p}" for h in hosts for p in paths] + [f"http://s{i}.h{i}.org/p{i}" for i in range(0, 160, 2)]
    rows = list(enumerate(urls)) + [(0, urls[8])]
    frame = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id int, url string, host string, rule string")
    got = url_filter.url_filter(frame, rules).collect()
    assert sorted((r["page_id"], r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in got) == sorted(
        (i, h, p, str(t), v) for i, u in rows for h, p, t, v in [brute_url(u, rules)])
    assert url_filter.url_filter(frame.limit(0), rules).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) AS key")
    listed = [f"k{i}" for i in range(0, 20_000, 97)] + ["absent"]
    levels = url_filter.build_cascade(universe, listed)
    got = universe.where(url_filter.is_listed(levels, universe["key"])).collect()
    assert {r["key"] for r in got} == {k for k in listed if k != "absent"}


def brute_license(text, phrases, templates):
    """The rule as stated: windows of words, whole notices with two words to spare, texts by four fifths."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, places, base = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, score = set(base), 1.0 if places else 0.0
    for label, notice, least, without in templates:
        n, wanted = len(notice.split()), set(notice.split())
        size, step = (n + 2, 1) if least == 1 else (2 * n, n)
        for start in range(0, len(words), step):
            block = set(words[start:start + size])
            if len(wanted & block) >= least * len(wanted) - 1e-9 and not block & set(without):
                labels.add(label)
                score = max(score, len(wanted & block) / len(wanted))
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score)


def labels_of(docs_frame, texts):
    got = license_scan.license_scan(docs_frame(list(enumerate(texts)))).collect()
    return {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in got}


def test_licenses_match_brute_force(docs_frame):
    rng = random.Random(6)
    vocab = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "the", "mit", "released", "under", "é", "4",
             "licensed", "apache", "version", "2", "0", "domain", "nc", "Work", "x"]
    rows = [(i, "".join(rng.choice(vocab) + rng.choice([" ", "-", "\n", ", ", "  "]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    pieces = [t.text.split() for t in license_scan.TEMPLATES]
    for i in range(150):  # parts of licence texts, with words lost and added, among others
        words = []
        for _ in range(rng.randint(1, 3)):
            words += [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
            words += [w for w in rng.choice(pieces) if rng.random() < 0.93]
        rows.append((1000 + i, rng.choice([" ", "\n", " - "]).join(words)))
    rows += [(900, None), (901, ""), (902, "CC BY CC-BY cc by"), (903, "Released under the MIT License."), (903, "nothing"),
             (None, "All rights reserved."), (905, "ccby éall rights reserved"), (906, "Released under the\nMIT License."),
             (907, "x " * 20_000 + "released under the mit license " + "y " * 20_000)]
    phrases = {**license_scan.PHRASES, "by cc by": "odd"}
    got = license_scan.license_scan(docs_frame(rows), phrases=phrases).collect()
    cols = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["doc_id"], *(r[c] for c in cols)) for r in got), key=key) == sorted(
        ((i, *brute_license(t, phrases, license_scan.TEMPLATES)) for i, t in rows), key=key)
    assert sum(bool(r["labels"]) for r in got) > 60
    assert license_scan.license_scan(docs_frame([])).count() == 0


def test_each_notice_has_its_own_label_and_no_other(docs_frame):
    cases = {
        "Released under the MIT License.": {"mit"}, "Released under the\nMIT License.": {"mit"}, "Licensed under CC BY 4.0": {"cc-by"},
        "Licensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc"}, "Licensed under CC BY-SA 4.0": {"cc-by", "cc-by-sa"},  # cc-by: the base phrase
        "Licensed under CC BY-NC-SA 4.0": {"cc-by", "cc-by-nc-sa"}, "Released under the Apache License.": set(), "... the MPL license": set(),
        "under the license released, and we used the mit lab": set(), "Licensed under the Apache License, Version 2.0.": {"apache"},
        "This work is licensed under the GNU General Public License, version 3.": {"gpl"}, "the GNU Lesser General Public License": {"lgpl"},
        "GNU Affero\nGeneral Public License": {"agpl"}, "This work has been released into the public domain": {"public-domain"},
        "Subject to the terms of the Mozilla Public License": {"mpl"}, "All rights reserved.": {"reserved"}, "some other text of no license": set(),
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the"
        ' "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish,'
        " distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so": {"mit"},
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:": {"bsd"},
        "Creative Commons Attribution-ShareAlike 4.0 International License": {"cc-by-sa"}, "Creative Commons Attribution 4.0 International": {"cc-by"},
        "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published"
        " by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": {"agpl"},
    }
    got = labels_of(docs_frame, list(cases))
    for i, (text, want) in enumerate(cases.items()):
        # a base label, as the phrase stands in them
        extra = {"gpl"} if "general public license" in " ".join(text.lower().split()) else set()
        assert got[i] == want | extra, (text, got[i])


def brute_lines_in_order(rows, t=0.8):
    texts = sorted({(i is None, i or 0, x) for i, x in rows if x is not None})
    seen, out = [], {}
    for none, i, text in texts:
        kept, lines = [], text.split("\n")
        for line in lines:
            ws = {w for w in re.split("[\x20\x09-\x0d]+", line) if w}
            gone = bool(ws) and any(len(ws & s) >= t * len(ws | s) - 1e-9 for s in seen)
            if ws:
                seen.append(ws)
            if not gone:
                kept.append(line)
        out[(None if none else i, text)] = "\n".join(kept), len(lines) - len(kept)
    return out


def test_lines_match_brute_force(docs_frame):
    rng = random.Random(9)
    vocab = [f"w{min(int(rng.expovariate(0.03)), 200)}" for _ in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 25))] for _ in range(60)]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(base))
            if rng.random() < 0.6:
                line[rng.randrange(len(line))] = rng.choice(vocab)
            if rng.random() < 0.2:
                rng.shuffle(line)
            lines.append(rng.choice([" ", "  ", "\t"]).join(line))
        rows.append((i * 3, "\n".join(lines + [""] * rng.randint(0, 1))))
    rows += [(1, None), (2, ""), (4, "\n \n"), (6, rows[2][1]), (0, rows[0][1]), (None, "some last words here now\n" + rows[5][1])]
    got = line_dedup.dedup_lines(docs_frame(rows)).collect()
    want = brute_lines_in_order(rows)
    assert len(got) == len(rows)
    left = sorted((str(r["doc_id"]), r["text"], r["lines_removed"]) for r in got if r["text"] is not None)
    assert left == sorted((str(i), *want[(i, t)]) for i, t in rows if t is not None)
    assert [r["text"] for r in got if r["doc_id"] == 1] == [None]
    assert got[0]["lang"] == "en" and line_dedup.dedup_lines(docs_frame([])).count() == 0


def test_one_id_with_different_texts(docs_frame):
    rows = [(1, "a b c d e\nx y z w q"), (1, "a b c d e\nsomething else entirely new"), (2, "x y z w q")]
    got = line_dedup.dedup_lines(docs_frame(rows)).collect()
    assert sum(r["text"].count("a b c d e") for r in got) == 1
    assert sum(r["text"].count("x y z w q") for r in got) == 1


def test_texts_are_read_once_for_the_heads_and_once_for_the_rest(docs_frame, monkeypatch):
    rng = random.Random(10)
    base = [[f"{a}{i}" for i in range(60)] for a in "xy"]
    rows = []
    for i in range(24):
        line = list(base[i % 2])
        for _ in range(rng.randint(0, 9)):
            line[rng.randrange(60)] = f"z{rng.randrange(400)}"
        rows.append((i, rng.choice([" ", "\t", "\r", "\x0b\x0c", " \t "]).join(line) + rng.choice(["", "\r", "\n \t\r"])))
    calls, read = [], line_dedup._words_of
    monkeypatch.setattr(line_dedup, "_words_of", lambda *a: calls.append(1) or read(*a))
    got = line_dedup.dedup_lines(docs_frame(rows)).collect()
    want = brute_lines_in_order(rows)
    assert sorted((r["doc_id"], r["text"], r["lines_removed"]) for r in got) == sorted((i, *want[(i, t)]) for i, t in rows)
    assert len(calls) == 2
