"""Quality, private data, HTML, licences, neighbours and media."""

import hashlib
import random
import re
import tarfile
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from peakweave.llm import html_text, licences, media, neighbours, private_data, quality

D = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    from peakweave.llm.queries import queries

    got = queries()["op1_quality"](spark, D)
    both = got.join(spark.read.parquet(f"{D}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert ((both.score >= 0.7).astype(int) == both.predicted).all()
    assert ((both.predicted == both.quality).mean()) > 0.9
    good, poor = both.score[both.quality == 1].to_numpy(), both.score[both.quality == 0].to_numpy()
    assert (good[:, None] > poor).mean() > 0.95  # area under the curve
    assert got.count() == 1000 and both.score.between(0, 1).all()
    assert {r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.collect()} == {True}


def test_network_gradients_match_differences():
    net = quality.ByteNet.fresh()
    held, y = [b"Some text to learn from, " * 30, b"!!## " * 90 + bytes(40)], np.array([1, 0], np.float32)

    def loss():
        h = [np.maximum(net.pooled(*quality.cut_up([t])[:2]) @ net.hidden + net.hidden_bias, 0) for t in held]
        z = np.array([np.concatenate([x.max(0), x.mean(0)]) @ net.out + net.out_bias for x in h])[:, 0]
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    g = net.gradients(held, y)
    for name in ("hidden_bias", "out", "filter_bias", "filters", "hidden"):
        w, k = getattr(net, name), int(np.abs(g[name]).argmax())
        old = w.flat[k]
        w.flat[k] = old + 1e-2
        up = loss()
        w.flat[k] = old - 1e-2
        slope = (up - loss()) / 2e-2
        w.flat[k] = old
        assert abs(slope - g[name].flat[k]) < 0.05 * abs(slope) + 1e-3


def test_chunks_cover_whole_texts():
    for n in (0, 1, 255, 256, 257, 480, 481, 5000):
        text = bytes(i % 255 + 1 for i in range(n))
        c = quality.chunks_of(text)
        assert all(c[k].tobytes() == text[k * quality.STEP : k * quality.STEP + quality.CHUNK].ljust(quality.CHUNK, b"\0") for k in range(len(c)))
        assert (len(c) - 1) * quality.STEP + quality.CHUNK >= n
        assert [round(x * quality.CHUNK) for x in quality.filled(n)] == [min(quality.CHUNK, n - k * quality.STEP) for k in range(len(c))]


def test_scores_of_whole_texts():
    """Brute force: every place of every chunk on its own; bytes 0 count as text."""
    net = quality.ByteNet.fresh(seed=4)
    r = np.random.default_rng(0)
    held = [b"", b"short", bytes(300), r.integers(0, 256, 5000).astype(np.uint8).tobytes(), b"words and words " * 20000]
    for t, got in zip(held, net.scores(held), strict=True):
        hidden = []
        for k in range(max(1, 1 + -(-(len(t) - quality.CHUNK) // quality.STEP))):
            part = t[k * quality.STEP : k * quality.STEP + quality.CHUNK]
            e = net.vectors[np.frombuffer(part.ljust(quality.CHUNK, b"\0"), np.uint8)]
            answers = [e[a : a + quality.WIDTH].reshape(-1) @ net.filters for a in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)]
            seen = np.append(np.maximum(np.max(answers, 0) + net.filter_bias, 0), len(part) / quality.CHUNK)
            hidden.append(np.maximum(seen @ net.hidden + net.hidden_bias, 0))
        z = np.concatenate([np.max(hidden, 0), np.mean(hidden, 0)]) @ net.out + net.out_bias[0]
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-3


def test_quality_without_labels(awkward, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    net = quality.fit(awkward, none)
    assert {r["score"] for r in quality.score(awkward, net).collect()} == {0.5}
    assert quality.keep(awkward, net, 0.4).count() == awkward.count()
    assert quality.score(nothing, net).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind != "ip" or all(int(x) <= 255 for x in m[0].split("."))) and (kind != "card" or (12 <= len(digits) <= 19 and luhn(digits))) and (kind != "phone" or 9 <= len(digits) <= 15):
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_private_base_spans(spark, awkward, nothing):
    r = random.Random(2)
    parts = ["a", "b.", "@", "1", "2", "55", ".", "-", " ", "+", "(", ")", "%", "é", "🙂", "\n", "x@y.z", "1.2.3.4", "256", "4111 1111 1111 1111", "+1 (988) 555-2485"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 60)))) for i in range(1500)]
    rows += [(9000, "a." * 5000 + "@" + "b." * 5000 + "c"), (9001, "1" * 20000), (9002, None), (9003, "x" * 50000 + "@")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["base_spans"] for x in private_data.private_data(docs).collect()}
    assert got == {i: brute_base(t or "") for i, t in rows}
    assert private_data.private_data(awkward).count() == awkward.count()
    assert private_data.private_data(nothing).count() == private_data.sanitised(nothing).count() == 0


def brute_terms(rows, support, least):
    """(value, term) -> share, from the definitions."""
    held, near, docs = {}, {}, {}
    for i, t in rows:
        for w in set(re.findall(r"[^\W\d_]{3,}", t.lower())):
            docs.setdefault(w, set()).add(i)
        for m in re.finditer(BASE["email"], t):
            v = m[0].lower()
            held.setdefault(v, set()).add(i)
            before, after = t[max(0, m.start() - private_data.REACH) : m.start()], t[m.end() : m.end() + private_data.REACH]
            before = re.sub(r"^[^\W\d_]+", "", before) if m.start() > private_data.REACH else before
            after = re.sub(r"[^\W\d_]+$", "", after) if len(t) > m.end() + private_data.REACH else after
            for w in re.findall(r"[^\W\d_]{3,}", f"{before}\n{after}".lower()):
                near.setdefault((v, w), set()).add(i)
    n, out = len(rows), {}
    for (v, w), both in near.items():
        own = np.log2(n / len(held[v]))
        share = np.log2(len(both) * n / (len(held[v]) * len(docs[w]))) / own if own > 0 else 0
        if len(both) >= support and share >= least:
            out[v, w] = share
    return out


def test_disclosing_terms(spark):
    r = random.Random(3)
    common = ["the", "and", "of", "text", "some", "more"]
    rows = []
    for i in range(200):
        words = [r.choice(common) for _ in range(12)] + [f"filler{chr(97 + i % 26)}{chr(97 + i // 26)}"]
        if i % 20 == 0:
            words[4:4] = ["director", "Zebulon", "zeb@corp.example.com", "of", "acme"]
        elif i % 20 == 1:
            words[4:4] = ["director"]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_terms(rows, 5, private_data.GENERALISE)
    assert {w for _, w in want} == {"zebulon", "acme"}
    out = {x["doc_id"]: x["text"] for x in private_data.sanitised(docs).collect()}
    for i, t in rows:
        if i % 20 == 0:
            assert "zeb" not in out[i].lower() and "acme" not in out[i] and "[EMAIL]" in out[i] and "director" in out[i]
        else:
            assert out[i] == t
    spans = {x["doc_id"]: x for x in private_data.private_data(docs).collect()}
    assert spans[0]["n_term"] == 2 and spans[1]["spans"] == ""
    for part in spans[0]["spans"].split(","):
        kind, a, b = part.split(":")
        assert rows[0][1][int(a) : int(b)].lower() in {"zebulon", "acme", "zeb@corp.example.com"}


def test_many_matches_in_one_text(spark):
    """100,000 matches and terms beside them: every place is right, and the time is that of one pass."""
    r = random.Random(8)
    parts = ["é", "zebulon ", "x@y.z ", " 10.0.0.1 ", "word ", "🙂", "+1 (988) 555-2485 ", "zebulon@y.z "]
    long = "".join(r.choice(parts) for _ in range(180_000))
    rows = [(i, f"Zebulon wrote x@y.z number{i}") for i in range(8)] + [(100, long)] + [(200 + i, "other text") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x["doc_id"]: x for x in private_data.private_data(docs).collect()}
    assert out[100]["base_spans"] == brute_base(long)
    emails = [m.span() for m in re.finditer(BASE["email"], long)]
    taken = np.zeros(len(long) + 1, int)
    for a, b in emails:
        taken[a:b] = 1
    words = [m.span() for m in re.finditer(r"[^\W\d_]+", long) if m[0].lower() == "zebulon" and not taken[m.start() : m.end()].any()]
    got = [tuple(map(int, x.split(":")[1:])) for x in out[100]["spans"].split(",") if x.startswith("term")]
    assert len(emails) > 20_000 and got == words and len(words) > 10_000
    clean = {x["doc_id"]: x["text"] for x in private_data.sanitised(docs).collect()}
    want, at = [], 0
    spans = [(a, b, k) for a, _, b, k in ((int(x.split(":")[1]), 0, int(x.split(":")[2]), x.split(":")[0]) for x in out[100]["spans"].split(","))]
    for a, b, kind in spans:
        if a >= at:
            want.append(long[at:a] + ("[" + kind.upper() + "]" if kind != "term" else ""))
        at = max(at, b)
    assert clean[100] == "".join(want) + long[at:] and clean[200] == "other text"


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">Home</a></li></ul></nav><header>Site name</header><div class="ad">Buy now.</div>
    <article><h1>A &amp; B</h1><p><b>First   paragraph<br>with a break.<p>Second&nbsp;one &lt;here&gt;.</p><ul><li>Item one</li><li>Item two</li></ul></article>
    <section class="comments"><p>Great post, thanks a lot for writing it.</p></section><form><p>Your mail?</p></form><footer>&copy; us</footer>"""
    want = "A & B\n\nFirst paragraph with a break.\n\nSecond one <here>.\n\nItem one\n\nItem two"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>" * 3000 + "Deep text that goes on. " * 2000), (5, "x", "no markup at all, but a sentence that is long enough to count. Yes.")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by_id = {r["page_id"]: r["text"] for r in got}
    assert by_id[1] == want and by_id[2] == by_id[3] == "" and len(got) == 6
    assert by_id[4] == ("Deep text that goes on. " * 2000).strip() and by_id[5] == rows[5][2]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_minimum_cut_against_all_cuts():
    r = random.Random(1)
    for _ in range(150):
        n = r.randint(1, 8)
        s, t = [float(r.randint(0, 6)) for _ in range(n)], [float(r.randint(0, 6)) for _ in range(n)]
        edges = {(i, j): float(r.randint(0, 4)) for i in range(n) for j in range(i) if r.random() < 0.5}
        cost = lambda k, n=n, s=s, t=t, edges=edges: sum(t[i] if k[i] else s[i] for i in range(n)) + sum(w for (i, j), w in edges.items() if k[i] != k[j])
        least = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_text.minimum_cut(s, t, edges)) - least) < 1e-9


def test_large_cuts():
    """Brute force over chains by dynamic programming; 50,000 ambiguous nodes take seconds."""
    import time

    r = random.Random(9)
    for n in (200, 50_000):
        s, t = [r.choice([0.0, 0.3, 0.9]) for _ in range(n)], [r.choice([0.0, 0.3, 0.9]) for _ in range(n)]
        edges = {(i, i + 1): r.choice([0.3, 0.6, 1.4]) for i in range(n - 1)}
        began = time.time()
        side = html_text.minimum_cut(s, t, edges)
        assert time.time() - began < 20
        kept, gone = t[0], s[0]
        for i in range(1, n):
            c = edges[i - 1, i]
            kept, gone = min(kept, gone + c) + t[i], min(gone, kept + c) + s[i]
        cost = sum(t[i] if side[i] else s[i] for i in range(n)) + sum(c for (i, j), c in edges.items() if side[i] != side[j])
        assert abs(cost - min(kept, gone)) < 1e-6 * n


PLAIN = [
    ("<div>Hello world</div>", "Hello world"),
    ("<div>" * 200 + "".join(f"<div>some nine words that stand here in block {i}</div>" for i in range(200)) + "</div>" * 200, "\n\n".join(f"some nine words that stand here in block {i}" for i in range(200))),
    ('<article><p>First one.</p><p><a href="/x">Only a link here</a></p><p>Last one.</p></article>', "First one.\n\nOnly a link here\n\nLast one."),
    ('<article><p aria-hidden="false">Shown.</p><p data-id="comment">Also shown.</p><p class="notice-board-history">History of boards.</p><p aria-hidden="true">Gone.</p><p hidden>Gone.</p></article>', "Shown.\n\nAlso shown.\n\nHistory of boards."),
    ('<header class="site-header">Site</header><div role="main"><header class="entry-header"><h1>Title</h1></header><p>Text.</p><div class="comment-list"><p>A reader wrote a long comment, and it goes on for some time.</p></div></div>', "Title\n\nText."),
    ("<script>if (a<b) x='</p>';</script><p>After a script's quote.</p>", "After a script's quote."),
    ("<p>1 < 2 and 3 > 2 &amp; more <a href=", "1 < 2 and 3 > 2 & more"),
    ("<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>About us</a></li></ul><p>" + "A long text that is the page's own. " * 9 + "</p>", ("A long text that is the page's own. " * 9).strip()),
    ("<b>" * 30_000 + "x" + "</i>" * 30_000, "x"),
    ('<a "' * 30_000 + "y", ""),
]


@pytest.mark.parametrize("k", range(len(PLAIN)))
def test_plain_pages(k):
    page, want = PLAIN[k]
    assert html_text.main_text(page) == want


def test_generated_pages():
    """Pages put together from parts whose text is known: what isn't a zone's is kept, in order, whatever the markup around it."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(r.randint(1, 30))).capitalize() + r.choice(".!?")

    def junk():
        kind = r.choice(["nav", "aside", "form", "footer", "script", "style", 'div class="ad"', 'div id="cookie-banner"', 'section class="comments"', 'div class="related"', 'ul class="menu"', 'div role="navigation"', 'div style="display: none"'])
        return f"<{kind}><p>{sentence()}</p>{'<a href=x>' + word() + '</a>' if r.random() < 0.5 else ''}</{kind.split()[0]}>" if kind not in ("script", "style") else f"<{kind}>{word()}('<p>{word()}</p>');</{kind}>"

    def block(out):
        text = " ".join(sentence() for _ in range(r.randint(1, 3)))
        out.append(text)
        inner = text.replace(" ", r.choice([" ", "  ", "\n", " <!-- x --> ", " <b></b> "]), 1)
        if r.random() < 0.3 and " " in text:
            first, rest = text.split(" ", 1)
            inner = f'<a href="/{word()}" title=\'a > b\'>{first}</a> {rest}'
        tag = r.choice(["p", "p", "h2", "li", "blockquote", 'p class="lead"', 'p data-x="nav"', "dd"])
        return f"<{tag}>{inner}" + ("" if tag == "p" and r.random() < 0.3 else f"</{tag.split()[0]}>")

    for _ in range(400):
        want: list[str] = []
        body = "".join(junk() if r.random() < 0.25 else block(want) for _ in range(r.randint(1, 14)))
        body = r.choice(["<article>{}</article>", '<div class="wrap has-sidebar"><main><section>{}</section></main></div>', '<div role="main">{}</div>', "<ARTICLE><div><div>{}</div></div></ARTICLE>"]).format(body)
        page = "<!DOCTYPE html><html><head><title>t</title></head><body class=nav-open>" + "".join(junk() for _ in range(r.randint(0, 3))) + "<header>Site</header>" + body + "".join(junk() for _ in range(r.randint(0, 3))) + r.choice(["", "</body></html>"])
        assert html_text.main_text(page) == "\n\n".join(want), page


MIT = """Copyright (c) 2020 Someone. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in it.
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. In no event shall the authors be liable for any claim."""


def test_licences(spark, awkward, nothing):
    rows = [(1, MIT), (2, "Text.\nLicensed under the Apache License, Version 2.0.\nMore."), (3, "Released under the MIT License. Licensed under CC BY-NC 4.0."), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "All rights reserved."), (6, "He was licensed to drive."), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licences.licence_scan(docs).collect()}
    assert got == {1: "MIT", 2: "Apache-2.0", 3: "CC-BY-NC,MIT", 4: "GPL-3.0", 5: "All-Rights-Reserved", 6: "", 7: ""}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(licences.oracle()).fetchall()
    assert sorted(map(tuple, licences.licence_scan(docs).collect())) == sorted(want)
    assert licences.licence_scan(awkward).count() == awkward.count() and licences.licence_scan(nothing).count() == 0


WRAPPED = {
    "MIT": """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice appears in all copies.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY.""",
}


def test_licences_over_lines(spark):
    marks = ["", " * ", "# ", "// ", ";; "]
    rows = [(f"{name}|{m}|{end!r}", end.join(m + line for line in t.split("\n"))) for name, t in WRAPPED.items() for m in marks for end in ("\n", "\r\n")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = licences.licence_scan(docs).collect()
    for r in got:
        assert r["licences"] == r["doc_id"].split("|")[0], r
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(map(tuple, got)) == sorted(con.execute(licences.oracle()).fetchall())
    rows = [(1, "Released under MIT\nLicensed under CC BY 4.0\nother words"), (2, "Copyright 2020 A\nAll rights reserved"), (3, "An essay\nthat goes on")]
    got = {r["doc_id"]: r["sequence"] for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MitNamed,CcBy", 2: "Copyright,Reserved", 3: ""}


def sampled(pattern, r):
    """A text that the pattern matches, by random choices at each of its parts."""
    from re import _parser as parser

    def of(tree):
        out = ""
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "ANY":
                out += r.choice("ab z")
            elif name == "IN":
                kind, value = r.choice(arg)
                out += chr(value if str(kind) == "LITERAL" else r.randint(*value))
            elif name == "BRANCH":
                out += of(r.choice(arg[1]))
            elif name == "SUBPATTERN":
                out += of(arg[-1])
            else:
                assert name == "MAX_REPEAT", name
                out += "".join(of(arg[2]) for _ in range(r.randint(arg[0], min(arg[1], arg[0] + 2))))
        return out

    return of(parser.parse(pattern))


def test_every_pattern_is_compared(spark):
    """No sentence that a pattern knows is passed over: each is given an identifier, its own or an earlier one's, in Spark and in SQL."""
    r = random.Random(5)
    order = list(licences.SENTENCES)
    rows = [(f"{i}|{k}", re.sub(" +", " ", sampled(p, r)).strip()) for i, p in licences.SENTENCES.items() for k in range(25)]
    rows = [(i, t) for i, t in rows if re.fullmatch(licences.SENTENCES[i.split("|")[0]], t)]
    assert len({i.split("|")[0] for i, _ in rows}) == len(order) and {x for ids, _ in licences.RULES for x in ids} <= set(order)
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = licences.licence_scan(docs).collect()
    for x in got:
        named = x["sequence"].split(",")
        assert x["n_sentences"] == 1 and order.index(named[0]) <= order.index(x["doc_id"].split("|")[0]), x
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(map(tuple, got)) == sorted(con.execute(licences.oracle()).fetchall())


def test_licences_without_the_word(spark):
    want = {"Released under the GPL v3.": "GPL-3.0", "Distributed under the GNU GPL, version 2.": "GPL-2.0", "Available under CC BY-SA 4.0.": "CC-BY-SA", "Released under the MIT.": "MIT", "Provided under BSD.": "BSD", "Dedicated to CC0.": "CC0-1.0"}
    got = {r["doc_id"]: r["licences"] for r in licences.licence_scan(spark.createDataFrame([(t, t) for t in want], "doc_id string, text string")).collect()}
    assert got == want


def test_neighbours(spark):
    r = np.random.default_rng(7)
    v = r.normal(size=(3000, 16)).astype(np.float32)
    v[100:400] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5050, [0.0] * 16), (5051, [float("nan")] * 16), (5100, [1.0, None] + [0.0] * 14), (5150, [1.0]), (5151, []), (None, v[0].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for x in neighbours.nearest_neighbours(table, F.col("vec_id") % 50 == 0, entry_block=700).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    hits = 0
    assert sorted(got) == list(range(0, 3000, 50))
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -2
        want = np.lexsort((np.arange(3000), -s.round(12)))[:5].tolist()
        found.sort()
        assert [k for k, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(s[i] - c) < 1e-9 for _, i, c in found)
        hits += len(set(want) & {i for _, i, _ in found})
    assert hits / (5 * len(got)) >= 0.9
    assert [i for _, i, _ in got[200]] == [100, 101, 102, 103, 104]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert neighbours.nearest_neighbours(few, F.col("vec_id") == 0).count() == 2
    assert neighbours.nearest_neighbours(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_repeated_ids_leave_room_for_others(spark):
    # one first half and one length, so one block
    flip = lambda k: [1.0] * 8 + [-1.0 if j == k else 1.0 for j in range(8)]
    rows = [(0, flip(None))] + [(1, flip(None))] * 12 + [(i, flip(i)) for i in range(2, 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    table = table.repartition(1)
    got = neighbours.nearest_neighbours(table, F.col("vec_id") == 0, entry_block=1000).collect()
    assert sorted(x["vec_id"] for x in got) == [1, 2, 3, 4, 5]
    assert sorted(x["rank"] for x in got) == [1, 2, 3, 4, 5]


def png_samples(image):
    """The samples of an 8-bit grey image of unfiltered rows, by the format's own rules."""
    assert image[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, chunks = 8, []
    while at < len(image):
        n = int.from_bytes(image[at : at + 4], "big")
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        assert int.from_bytes(image[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + data)
        chunks.append((kind, data))
        at += 12 + n
    assert [k for k, _ in chunks] == [b"IHDR", b"IDAT", b"IEND"]
    width, height = (int.from_bytes(chunks[0][1][k : k + 4], "big") for k in (0, 4))
    assert chunks[0][1][8:] == bytes([8, 0, 0, 0, 0])
    raw = zlib.decompress(chunks[1][1])
    assert len(raw) == height * (width + 1) and not any(raw[:: width + 1])
    return b"".join(raw[k * (width + 1) + 1 : (k + 1) * (width + 1)] for k in range(height))


def test_media(spark, awkward, nothing, tmp_path):
    folder = str(tmp_path / "shards")
    got = media.media_columns(awkward, folder=folder).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in awkward.collect()}
    assert len(got) == awkward.count()
    for r in got:
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert r["n_bytes"] == len(raw) and len(payload) % 576 == 0 and len(payload) == r["payload_bytes"] > 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        with open(tmp_path / "shards" / r["shard"], "rb") as f:
            f.seek(r["offset"])
            image = f.read(r["length"])
        assert png_samples(image) == payload
        assert r["media_sha256"] == hashlib.sha256(image).hexdigest() and r["media_bytes"] == len(image)
        samples = np.frombuffer(payload, np.uint8)
        shares = [((samples >= 64 * k) & (samples < 64 * (k + 1))).mean() for k in range(4)]
        assert r["feature"] == f"576x{len(payload) // 576}x8;mean={samples.mean():.4f};" + ",".join(f"{x:.4f}" for x in shares)
    names = set()
    for shard in (tmp_path / "shards").iterdir():
        with tarfile.open(shard) as t:
            for m in t:
                names.add(m.name)
                assert hashlib.sha256(media.from_png(t.extractfile(m).read())).hexdigest() == m.name.removesuffix(".png")
    assert names == {f"{r['payload_sha256']}.png" for r in got}
    stored = sum(len(tarfile.open(shard).getnames()) for shard in (tmp_path / "shards").iterdir())
    assert stored == len(names)  # once each, though rows repeat
    for r in got:
        with open(tmp_path / "shards" / r["shard"], "rb") as f:
            f.seek(r["offset"])
            image = f.read(r["length"])
        assert hashlib.sha256(media.from_png(image)).hexdigest() == r["digest"] == r["payload_sha256"]
        assert (r["width"], r["height"], r["depth"]) == media.read_header(image[: media.HEADER]) == (576, r["payload_bytes"] // 576, 8)
    assert media.media_columns(nothing).count() == 0


def test_damaged_image_is_an_error():
    image = bytearray(media.to_png(b"\xff" * 576))
    image[50] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(image))
