"""Each operator against a plain version of its contract, on awkward rows."""

import hashlib
import math
import pathlib
import random
import re
import struct
import threading
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexloom.llm import ann, bpe, chat, common, html, langid, licenses, packing, quality, sharding, simhash, token_ids
from lexloom.llm.components import components
from tests.llm.conftest import AWKWARD, DOCS, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# 1


def license_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in at}))


LICENSED = [
    *AWKWARD, "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0 and cc by; MIT License, mit license MIT LICENSE", "gnu general public license gnu general public license, version 3", "cc bye, mit licenses",
    "SPDX-License-Identifier: BSD 3-Clause", "GNU Affero General Public License", "die mit den",
]


def test_licenses(spark, folder):
    out = licenses.op1(spark, folder(documents=documents(*LICENSED))).collect()
    assert len(out) == len(LICENSED)
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_base(LICENSED[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by = {LICENSED[r.doc_id]: r for r in out if LICENSED[r.doc_id]}
    assert by[LICENSED[len(AWKWARD)]].labels == "apache,apache-2.0" and by[LICENSED[len(AWKWARD)]].n_detections == 1
    assert by["SPDX-License-Identifier: BSD 3-Clause"].labels == "bsd-3-clause"
    assert by["GNU Affero General Public License"].labels == "agpl-3.0"
    assert by["die mit den"].labels == ""
    again = documents("MIT License, 2020", "MIT License, 2020", None)
    assert rows(licenses.op1(spark, folder(documents=(again[0] + again[0][:1], again[1]))), "doc_id", "labels", "n_base") == [(0, "mit", 1), (0, "mit", 1), (1, "mit", 1), (2, "", 0)]
    assert licenses.op1(spark, folder(documents=([], DOCS))).count() == 0


def test_inner_detections_are_suppressed():
    assert licenses.left_over([(0, 8, 4, 1.0, "a", 0), (2, 5, 1, 0.5, "b", 1), (7, 9, 1, 0.5, "c", 2), (0, 8, 4, 1.0, "d", 3)]) == [(0, 8, 4, 1.0, "a", 0), (7, 9, 1, 0.5, "c", 2)]
    rng = random.Random(24)
    for _ in range(500):
        found = [(a := rng.randint(0, 12), a + rng.randint(1, 6), rng.randint(1, 3), 0.5, "x", k) for k in range(rng.randint(0, 14))]
        over = lambda k, d: k[2] >= d[2] and k[0] <= d[0] and d[1] <= k[1] and (k[:3] != d[:3] or k[5] < d[5])
        assert licenses.left_over(found) == sorted(d for d in found if not any(over(k, d) for k in found if k is not d))


def test_detections_against_plain_search():
    """Every rule is searched in the whole text, and its place counted in words, whatever words gate it."""
    rng = random.Random(25)
    parts = ["Licensed under the", "MIT License", "Apache License, Version 2.0", "GNU Lesser General Public License v3", "See the", "BSD 2-Clause", "for details.", "All rights reserved", "Copyright (c) 2020", "© 1999", "SPDX-License-Identifier:", "CC BY-SA 4.0", "word", "ΣΣ"]
    parts += [re.sub(r"\(\?:([^()|]*)[^()]*\)\??|[?\\]", r"\1", t[2]) for t in licenses.TEXTS if not re.search(r"[+{}]|S ", t[2])][:60]
    for _ in range(300):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        words = [w.decode() for w in licenses.words_of(text)]
        line, found = " " + " ".join(words) + " ", []
        for k, r in enumerate(licenses.RULES):
            if set(r.needs) <= set(words):
                found += [(line[: licenses.own_start(m) + 1].count(" ") - 1, line[: m.end() + 1].count(" ") - 1, r.priority, r.confidence, r.label, k) for m in r.pattern.finditer(line)]
        got = licenses.detections(licenses.words_of(text), set(licenses.words_of(text)))
        assert got == licenses.left_over(found)
        assert set(licenses.scanned(text)["labels"].split(",")) - {""} >= {d[4] for d in got}


def test_every_signature_fires():
    """A text made from each hand-written signature has its label, so that every one passes its gate."""
    for label, word, text, _, _ in licenses.TEXTS:
        for plain in [text] if re.search(r"\(", text) else text.split("|"):
            plain = re.sub(r"\(\?:(?:19\|20)\)\\d\\d", "2001", plain)
            plain = re.sub(r"\(\?:\\S\+ \)\{1,\d+\}", "acme ", plain).replace(r"\S+ ", "acme ").replace(r"\d", "3").replace("[cs]", "c").replace("[01]", "1").replace("[12]", "1").replace("[15]", "5").replace("[bc]", "b")
            while (new := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", plain)) != plain:
                plain = new
            plain = plain.replace("e?ment", "ement").replace("s? ", "s ").replace("?", "")
            hits = licenses.detections(w := licenses.words_of(plain), set(w))
            assert label in {h[4] for h in hits} or any(h[2] >= 4 for h in hits), (label, plain)
            rule = next(r for r in licenses.RULES if r.label == label and r.needs == (word,) and r.pattern.pattern == f" (?:{text})(?= )")
            assert rule.pattern.search(f" {' '.join(x.decode() for x in w)} ") and word.encode() in w, (label, plain)


CITED = {
    "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0", "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0", "SPDX-License-Identifier: ISC": "isc",
    "SPDX-License-Identifier: Zlib": "zlib", "SPDX-License-Identifier: EPL-2.0": "epl-2.0", "SPDX-License-Identifier: BSL-1.0": "bsl-1.0", "SPDX-License-Identifier: PostgreSQL": "postgresql",
    "license: MIT": "mit", "Licensed under the MIT": "mit", "released under GPL v3": "gpl-3.0", "GNU GPL version 2": "gpl-2.0",
    "SPDX-License-Identifier: (LGPL-2.1-or-later OR BSD-3-Clause) AND MIT": "bsd-3-clause,lgpl-2.1,mit", "SPDX-License-Identifier: MIT-0": "mit-0", "License: BSD": "bsd", "it is licensed under the terms of the MPL 2.0": "mpl-2.0",
    "dual licensed under MIT and nothing else": "mit", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR EPL-2.0": "epl-2.0,gpl-2.0", "published under Apache v2": "apache-2.0",
}
PROSE = [
    "She studied at MIT and then joined ISC.", "The zlib library compresses.", "We run PostgreSQL 16 on BSD, with OpenSSL.", "They got a license in May. MIT said so.", "die Kinder kamen mit dem Zug", "The EPL 2.0 season, in version 1.0",
    "under the sea, mit Freude", "GPL and LGPL are names.", "X11 and mpl plots", "The licence was for PHP 3 01.",
]


def test_short_names_count_where_they_are_cited():
    for text, want in CITED.items():
        assert licenses.scanned(text)["labels"] == want, text
    for text in PROSE:
        found = licenses.scanned(text)["labels"]
        assert found in ("", "lgpl"), (text, found)  # lgpl is a name in itself
    for label, word, name in licenses.IDENTIFIERS:  # every one of them fires, in every form, past its gate
        plain = name.replace("(?! [234] clause)", "").replace(r" (?:version |v )?v?", " v").replace("v?", "")
        while (new := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", plain)) != plain:
            plain = new
        plain = plain.replace("[01]", "1").replace("[0-3]", "1").replace("[bc]", "b")
        for cited in ("SPDX-License-Identifier: {}", "SPDX-License-Identifier: X-1.0 OR {}", "is licensed under the {}.", "released under {}", "License: {}"):
            assert label in licenses.scanned(cited.format(plain))["labels"].split(","), (label, cited, plain)


def test_alternatives_of_names_pass_their_gate():
    assert licenses.scanned("Use AGPLv3, please.")["labels"] == "agpl-3.0"
    assert licenses.scanned("The Zero-Clause BSD it is.")["labels"] == "0bsd"
    for label, word, name in licenses.LICENSES:
        for alternative in name.split("|") if "(" not in name else [name]:
            assert "|" in alternative or word in alternative, (label, alternative)


def test_a_long_list_of_notices():
    text = "Licensed under the Apache License, Version 2.0. All rights reserved. Copyright (c) 2020 MIT License. " * 40_000
    r = licenses.scanned(text)
    assert r["n_base"] == 80_000 and r["labels"] == "all-rights-reserved,apache,apache-2.0,copyright,mit" and r["last_word"] == r["n_words"] - 2


# 2

ARTICLE = "<article><h1>Head &amp; line</h1><p><b>One two,\n three.<br><p>Four <a href=x>five</a>, six.</p><header>Kicker</header><p>Thing.</p><div class='ad-box'>Buy, now.</div><aside>Side, note.</aside><section id=comments><p>Nice, very.</p></section></article>"
PAGES = [
    (f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header>Top</header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- x --><div class='cookie notice'>We use, cookies.</div>{ARTICLE}<form><input>Mail, me.</form><footer>Foot, er.</footer>", "Head & line\nOne two, three.\nFour five, six.\nKicker\nThing."),
    ("<div><div class=menu>a b</div><div id=content><p>First, sentence of text.</p><p>Second one, here.</p><p>Third.</p></div><div class=footer>x</div></div>", "First, sentence of text.\nSecond one, here.\nThird."),
    ("<div class='page withSidebar header'>Top, x.<article><p>The text, of it all.</p></article><article class=comment-body><p>Nice, text indeed.</p></article></div>", "The text, of it all."),
    ("<body class=nav><div id=adTop>Buy, it now.</div><p>The text, of it all.</p><ul class=commentlist><li>Well, said.</li></ul>", "The text, of it all."),
    ("plain text, no tags.", "plain text, no tags."), (None, ""), ("", ""), ("<nav>only</nav>", ""), ("<p>a &lt; b &#233;&nbsp;c</p>", "a < b é c"), ("<p>open <", "open <"), ("<script>x", ""),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_main_text(page, want):
    assert html.main_text(page) == want


LONG = "Some text, with a comma and a stop. " * 12
WHOLE_PAGES = [
    (f"<body><div class=menu>a b</div><div id=post><h1>Head</h1><p>A lead, of one line.</p><div class=body><p>{LONG}</p><p>{LONG}</p></div></div></body>", ["Head", "A lead, of one line.", LONG.strip(), LONG.strip()]),
    (f"<body><div id=post><h1>Head</h1><div class=body><p>{LONG}</p></div></div><div class=footer>x</div></body>", ["Head", LONG.strip()]),
    (f"<body><div id=post><p>{LONG}</p><blockquote><p>{LONG * 4}</p></blockquote><p>{LONG}</p></div></body>", [LONG.strip(), (LONG * 4).strip(), LONG.strip()]),
    (f"<body><article><p>{LONG}</p><article><p>{LONG}{LONG}</p></article><p>Last, of all.</p></article></body>", [LONG.strip(), (LONG + LONG).strip(), "Last, of all."]),
    (f"<body><article><p>{LONG}{LONG}</p></article><article><p>{LONG}</p></article></body>", [(LONG + LONG).strip(), LONG.strip()]),
]


FORMS = [
    (f"<body><form id=aspnetForm action=x><div class=menu>a b</div><div id=post><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div><label>Mail, me. Now.</label><button>Go, on.</button></form></body>", ["Head", LONG.strip(), LONG.strip()]),
    (f"<form><article><p>The text, of it all.</p></article><div class=footer>x</div></form>", ["The text, of it all."]),
    (f"<form><p>{LONG}</p></form>", [LONG.strip()]),
    (f"<article><p>{LONG}</p></article><form><p>Write, to us. We answer, mostly. {'Or so, we think. ' * 9}</p><input></form>", [LONG.strip()]),
    (f"<div><p>{LONG}{LONG}</p><form><p>{LONG}</p></form><p>Last, of all.</p></div>", [(LONG + LONG).strip(), "Last, of all."]),
    (f"<form><p>{LONG}</p><form><p>Inner, one.</p></form></form><p>After, it.</p>", [LONG.strip(), "Inner, one.", "After, it."]),
    ("<form><p>Search, here.</p></form>", [""]),
]


@pytest.mark.parametrize(("page", "want"), FORMS)
def test_forms_are_judged_by_score(page, want):
    assert html.main_text(page).split("\n") == want


@pytest.mark.parametrize("first", ["<p>One, here.</p>", "<div><p>One, here.</div>", "One, here.", "<br>One, here.", "<article>One, here.</article>", "<span>One, here.</span>"])
def test_an_open_head_ends_where_the_standard_ends_it(first):
    page = f"<!doctype html><html><head><meta charset=x><title>T</title>\n<style>x</style><link rel=y><script>var z;</script><noscript>no</noscript>{first}<p>Two, there.</p>"
    assert html.main_text(page) == "One, here.\nTwo, there."


def plain_choice(blocks, good):
    """The choice of the section by its definition, over sets of ancestors."""

    def ancestors(e):  # itself first
        out = [e]
        while out[-1].parent is not None:
            out.append(out[-1].parent)
        return out

    above = {id(b): ancestors(b.holder) for b in blocks}
    within = lambda b, e: any(x is e for x in above[id(b)])
    content = [b for b in blocks if b.path.number in good and b.linked < len(b.text)]
    if not content:
        return ""
    sections, page = html.SECTIONS | html.PAGE, ("", "html", "body")
    top = next(e for e in above[id(content[0])] if e.tag in sections and all(within(b, e) for b in content))
    while top.tag not in page and top.parent.tag in sections and top.parent.tag not in page and all(b.holder.tag in html.HEADINGS for b in blocks if within(b, top.parent) and not within(b, top)):
        top = top.parent
    taken = []
    for b in blocks:
        if not within(b, top):
            continue
        if top.tag in page:
            if b.holder is top:
                if b.path.number not in good:
                    continue
            else:
                part = above[id(b)][[x is top for x in above[id(b)]].index(True) - 1]
                if not any(within(c, part) for c in content) and not (part is b.holder and part.tag in html.HEADINGS):
                    continue
        if not b.path.hint or b.path.number in good:
            taken.append(b.text)
    return "\n".join(taken)


def test_the_section_is_chosen_as_defined(monkeypatch):
    rng, chosen = random.Random(28), html.content_paths
    for n in range(600):
        page = random_page(rng)
        if n % 2:
            page = "".join(rng.choice(["<div>", "</div>", "<section>", "</section>", "<h1>Head</h1>", "<body>", f"<p>{LONG}</p>", "<p>x y</p>", "<div class=ad>Buy, it.</div>", "bare, text", "<td>"]) for _ in range(rng.randint(1, 25)))
        blocks = html.blocks_of(page)
        ties = {b.path.number for b in blocks if rng.random() < 0.3}
        for good in (chosen(blocks) if blocks else set(), ties):  # any choice of paths, too
            monkeypatch.setattr(html, "content_paths", lambda _, good=good: good)
            assert html.main_text(page) == plain_choice(blocks, good), page


def test_a_path_at_the_threshold_is_content(monkeypatch):
    blocks = html.blocks_of(f"<div><p>{LONG}</p></div><ul><li>A, b.</li></ul>")
    scores = html.path_scores(blocks)
    low = min(scores, key=lambda p: scores[p][0])
    mean = sum(f * n for _, f, n in scores.values()) / sum(n for _, _, n in scores.values())
    monkeypatch.setattr(html, "THRESHOLD", scores[low][0] / mean)
    at = scores[low][0] >= html.THRESHOLD * mean  # but for rounding, always
    assert (low in html.content_paths(blocks)) == at
    monkeypatch.setattr(html, "THRESHOLD", scores[low][0] / mean * 1.000001)
    assert low not in html.content_paths(blocks)


@pytest.mark.parametrize(("page", "want"), WHOLE_PAGES)
def test_no_part_of_the_main_text_is_dropped(page, want):
    assert html.main_text(page).split("\n") == want


def plain_scores(page):
    """Scores by tag path, by plain loops over the page's blocks."""
    blocks, out = html.blocks_of(page), {}
    for hinted in (False, True):
        order, ratios = [], []
        for b in blocks:
            out.setdefault(b.path.number, 0.0)
            if bool(b.path.hint) == hinted and b.path.number not in order and any(c.path.number == b.path.number and c.linked < len(c.text) for c in blocks):
                order.append(b.path.number)
        for p in order:
            mine = [b for b in blocks if b.path.number == p]
            letters = sum(max(0, len(b.text) - b.linked) for b in mine)
            marks = sum(sum(c in ".,;:!?…。，、！？" for c in b.text) for b in mine if b.linked < len(b.text))
            ratios.append((math.log(1 + letters / len(mine)), math.log(1 + marks / len(mine))))
        for i, p in enumerate(order):
            around = [ratios[max(0, i - 1)], ratios[i], ratios[min(len(order) - 1, i + 1)]]
            length, marks = ratios[i] if hinted else (sum(w * r[k] for w, r in zip((0.25, 0.5, 0.25), around)) for k in (0, 1))
            path = next(b.path for b in blocks if b.path.number == p)
            out[p] = length * (0.5 + marks) * (6 if path.article else 1) * (0.04 if hinted else 1)
    return out


def random_page(rng):
    out = []
    for _ in range(rng.randint(1, 30)):
        tag = rng.choice(["div", "p", "li", "div class=ad", "section id=comments", "article", "h2", "b", "a href=x", "td"])
        words = " ".join(rng.choice(["one", "two,", "three.", "<br>", "&amp;"]) for _ in range(rng.randint(0, 12)))
        out.append(f"<{tag}>{words}" + (f"</{tag.split()[0]}>" if rng.random() < 0.7 else ""))
    return "".join(out)


def test_path_scores_against_plain_loops():
    rng = random.Random(22)
    for page in [random_page(rng) for _ in range(300)] + [p for p, _ in PAGES + WHOLE_PAGES if p]:
        got, want = {p: s[0] for p, s in html.path_scores(html.blocks_of(page)).items()}, plain_scores(page)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_blocks_against_the_standard_library():
    """Without end tags left out, blocks are the texts between block tags; nothing outside of NEVER is lost."""
    rng = random.Random(23)
    for _ in range(100):
        texts = [f"text {i}, of it." for i in range(rng.randint(1, 20))]
        page = "".join(f"<{(t := rng.choice(['div', 'p', 'section', 'h3']))} title={rng.choice(['x', 'don' + chr(39) + 't', chr(34) + 'a > b' + chr(34)])}>{x}</{t}>" for x in texts)
        assert [b.text for b in html.blocks_of(page)] == texts


def test_scores_choose(monkeypatch):
    long, short = "A sentence, with stops; and more, of it. " * 4, "Buy it now"
    page = f"<div class=ad><p>{short}</p></div><div><h2>Head</h2><p>{long}</p><p>{long}</p></div>"
    assert html.main_text(page).split("\n") == ["Head", long.strip(), long.strip()]
    hinted = f"<article><h2>Head</h2><p>Some text, short.</p><ul><li>One, item.</ul><div class=legal><p>{long * 60}</p></div><div class=ad><p>Buy, it.</p></div></article>"
    assert html.main_text(hinted).split("\n") == ["Head", "Some text, short.", "One, item.", (long * 60).strip()]  # a class alone does not remove what scores as content
    monkeypatch.setattr(html, "content_paths", lambda blocks: {b.path.number for b in blocks})
    assert short in html.main_text(page).split("\n") and "Buy, it." in html.main_text(hinted)


BOILERPLATE = [
    "<div class='sidebar'>{}</div>", "<div id=comments><div class=comment><p>{}</p></div><div class=comment><p>{}</p></div></div>", "<section class='comment-list'><p>{}</p></section>", "<div class='cookie-notice'><p>{}</p></div>",
    "<header><div>{}</div></header>", "<aside><p>{}</p></aside>", "<form><label>{}</label></form>", "<nav><p>{}</p></nav>", "<div role=navigation>{}</div>", "<div class='ad-box top'>{}</div>", "<footer><p>{}</p></footer>",
    "<ul class=menu><li><a href=x>{}</a></li></ul>", "<div class='newsletterSignup'><p>{}</p></div>", "<div><a href=x>{}</a></div>", "<noscript>{}</noscript>", "<div class=related><a href=y>{}</a></div>", "<!-- {} -->", "<script>var x = '{}';</script>",
]


@pytest.mark.parametrize("seed", range(6))
def test_boilerplate_of_many_kinds(seed):
    rng = random.Random(seed)
    sentence = lambda n: " ".join(rng.choice(["one", "two,", "three;", "four", "five."]) for _ in range(n)) + "."
    for _ in range(300):
        texts = [sentence(rng.randint(4, 60)) for _ in range(rng.randint(2, 8))]
        article = "<h1>Some head</h1>" + "".join(f"<p>{t}</p>" for t in texts)
        holder = rng.choice(["<div id=content>{}</div>", "<table><tr><td>{}</td></tr></table>", "<article>{}</article>", "<main><article>{}</article></main>", "<div class=page><article class=post>{}</article></div>"])
        around = [rng.choice(BOILERPLATE).replace("{}", sentence(rng.randint(2, 60))) for _ in range(rng.randint(0, 6))]
        at = rng.randint(0, len(around))
        page = "<html><head><title>T</title></head><body>" + "".join(around[:at]) + holder.format(article) + "".join(around[at:]) + "</body></html>"
        assert html.main_text(page).split("\n") == ["Some head", *texts], page


def test_one_word_of_a_class_name_is_no_hint():
    text = "".join(f"<div class={c}><p>On {c}, a line.</p></div>" for c in ("share-price", "copyright-law", "related-work", "commentary"))
    assert html.main_text(f"<article><p>First, of all.</p>{text}</article>").count("\n") == 4


def test_quotes_count_only_behind_an_equals_sign():
    page = "<article><p title=don't>One, here.</p><p>Two, lost.</p><p data-x=\"a > b\" class='y'>It's three, ok.</p></article>"
    assert html.main_text(page) == "One, here.\nTwo, lost.\nIt's three, ok."


def test_long_and_deep_pages():
    n = 30_000
    assert html.main_text("<div>" * n + "Text, here." + "</div></b>" * n) == "Text, here."
    assert html.main_text("<article>" + "<p>A line, of text." * n + "</article>").count("\n") == n - 1
    assert html.main_text("<!" * n + "<" * n) == ""


def test_pages(spark, folder):
    sf = folder(pages=([(i, f"u{i}", p) for i, (p, _) in enumerate(PAGES)] + [(None, None, "<p>x</p>")], "page_id long, url string, html string"))
    got = {r.page_id: (r.text, r.n_chars) for r in html.op2(spark, sf).collect()}
    assert got == {None: ("x", 1)} | {i: (w, len(w)) for i, (_, w) in enumerate(PAGES)}
    again = [(1, "u", PAGES[1][0]), (1, "u", PAGES[1][0]), (2, None, None)]
    assert rows(html.op2(spark, folder(pages=(again, "page_id long, url string, html string"))), "page_id", "n_chars") == [(1, len(PAGES[1][1]))] * 2 + [(2, 0)]
    assert html.op2(spark, folder(pages=([], "page_id long, url string, html string"))).count() == 0


# 3


def true_neighbours(vectors, top=10):
    out = {}
    for q, v in vectors.items():
        if q % 100 == 0:
            d = sorted((float(np.sqrt(((np.array(w, float) - np.array(v, float)) ** 2).sum())), i) for i, w in vectors.items() if i != q)
            out[q] = [i for _, i in d[:top]]
    return out


def test_neighbours(spark, folder):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    good = {i: (centres[i % 12] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist() for i in range(3000)}
    good |= {i: good[0] for i in range(3000, 3700)}  # a hot vector
    bad = [(9000, None), (9100, []), (9200, [0.0] * 16), (9300, [float("nan")] * 16), (9400, [None] + [1.0] * 15), (9500, [float("inf")] * 16), (None, [1.0] * 16)]
    sf = folder(embeddings=(list(good.items()) + bad + [(100, good[100])], "vec_id long, embedding array<float>"))
    got = {}
    for q, rank, v, s in rows(ann.op3(spark, sf), "query_id", "rank", "vec_id", "score"):
        assert rank == len(got.setdefault(q, [])) + 1
        assert abs(s - float(np.sqrt(((np.array(good[v], float) - np.array(good[q], float)) ** 2).sum()))) < 1e-12
        got[q].append(v)
    want = true_neighbours(good)
    assert got.keys() == want.keys()
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
    assert got[0] == list(range(3000, 3010))  # ties to the smaller ids
    few = folder(embeddings=([(0, [1.0, 2.0]), (5, [1.0, 3.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<float>"))
    assert rows(ann.op3(spark, few), "query_id", "rank", "vec_id") == [(0, 1, 5), (0, 2, 7)]
    assert ann.op3(spark, folder(embeddings=([], "vec_id long, embedding array<float>"))).count() == 0


def test_an_outlier_has_its_neighbours_too(spark, folder):
    rng = np.random.default_rng(18)
    centres = 10 * rng.normal(size=(30, 8))
    good = {i: centres[i % 30].tolist() for i in range(12_000)}  # a leaf each, so that one visit is enough for nearly all
    good |= {i: (1e3 * rng.normal(size=8)).tolist() for i in (500, 4300)}
    twice = [(4300, good[4300])] * 30
    got = rows(ann.op3(spark, folder(embeddings=(list(good.items()) + twice, "vec_id long, embedding array<double>"))), "query_id", "rank")
    assert got == [(q, k) for q in range(0, 12_000, 100) for k in range(1, 11)]


def test_clustered_vectors_are_found_in_few_leaves(spark, monkeypatch):
    """What the tree is for: where vectors stand in clusters, a small part of them is compared; and the rounds give out few rows."""
    rng = np.random.default_rng(31)
    centres = rng.normal(size=(150, 24))
    v = centres[rng.integers(0, 150, 12_000)] + 0.15 * rng.normal(size=(12_000, 24))
    seen = []
    old = ann.calibrated
    monkeypatch.setattr(ann, "calibrated", lambda spark, tree, *a: seen.append((old(spark, tree, *a), tree)) or seen[-1][0])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for q, i in rows(ann.search(spark, df), "query_id", "vec_id"):
        got.setdefault(q, []).append(i)
    want = true_neighbours(dict(enumerate(v)))
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 10 * len(want)
    (visits, _), tree = seen[0]
    sizes = np.bincount(tree.assigned(v), minlength=tree.leaves)
    compared = np.mean([sum(sizes[leaf] for leaf in tree.leaves_by_distance(v[q], visits)) for q in want]) / len(v)
    assert compared < 0.2


def test_rounds_give_the_same_as_one_look(spark, monkeypatch):
    rng = np.random.default_rng(32)
    v = np.round(rng.normal(size=(3000, 4)), 1)  # many ties
    v[:900] = v[0]  # a hot vector
    df = spark.createDataFrame([(i // 2 if i > 2900 else i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    answers = []
    for first, cell, lot in ((4, 4096, 512), (1, 64, 2), (10_000, 10_000, 512)):
        monkeypatch.setattr(ann, "FIRST", first)
        monkeypatch.setattr(ann, "CELL", cell)
        monkeypatch.setattr(ann, "LOT", lot)
        answers.append(rows(ann.search(spark, df), "query_id", "rank", "vec_id", "score"))
    assert answers[0] == answers[1] == answers[2]


def test_full_leaves_are_split(spark, monkeypatch):
    """With an upper tree of few leaves: recall holds, bins stay small, and few vectors are compared; a hot vector is in it, too."""
    rng = np.random.default_rng(33)
    centres = rng.normal(size=(200, 16))
    v = centres[rng.integers(0, 200, 12_000)] + 0.2 * rng.normal(size=(12_000, 16))
    v[5000:9000] = v[5000]
    for name, value in {"SAMPLE": 160, "GROW": 150, "CELL": 100, "SUB": 300, "LOT": 7, "LEAF": 16, "LEAST": 4}.items():
        monkeypatch.setattr(ann, name, value)
    seen, compared = {}, []
    calibrated, split = ann.calibrated, ann.split
    monkeypatch.setattr(ann, "calibrated", lambda *a: seen.setdefault("visits", calibrated(*a)))
    monkeypatch.setattr(ann, "split", lambda *a: seen.setdefault("split", split(*a)))
    cleared = ann.cleared
    monkeypatch.setattr(ann, "cleared", lambda *a: (compared.extend(seen["split"][0].groupBy("leaf", "sub").count().toPandas()["count"]), cleared(*a)))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for q, i in rows(ann.search(spark, df), "query_id", "vec_id"):
        got.setdefault(q, []).append(i)
    want = true_neighbours(dict(enumerate(v)))
    near = {q: [i for i in want[q] if not 5000 <= i < 9000] for q in want}  # of equal ones any may be found first
    assert all(len(got[q]) == 10 for q in want)
    assert sum(len(set(got[q]) & set(near[q])) for q in want) >= 0.88 * sum(map(len, near.values()))
    assert got[5000] == list(range(5001, 5011)) and seen["visits"][1] < 1
    assert len(compared) > 200 and np.median(compared) < 60 and sum(compared) == 12_000


def test_very_large_and_very_small_vectors(spark):
    data = [(0, [1e200, 0.0]), (1, [1e200, 1e190]), (2, [-1e200, 0.0]), (3, [1e-200, 0.0]), (100, [2e-200, 0.0])]
    got = {}
    for r in ann.search(spark, spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(got) == [0, 100] and sorted(got[0])[0] == (1, 1) and sorted(got[100])[0] == (1, 3) and len(got[0]) == len(got[100]) == 4


# 4, 5


def random_texts(n, seed=2):
    rng = random.Random(seed)
    alphabet = "aaabcdeehinorstth'  \n.,!?0123éüßñΣσ½😀<|>#İı\x1c ́"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(n)]


def test_ids_are_the_tokenizers():
    texts = [t or "" for t in AWKWARD] + random_texts(600)
    one, many = bpe.Bpe(PATH), token_ids.TokenIds(PATH)
    for t, raw in zip(texts, many.encoded(texts), strict=True):
        want = TOKENIZER.encode(t, add_special_tokens=False).ids
        assert one.encode(t) == want
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == want
        assert one.decode(want) == TOKENIZER.decode(want, skip_special_tokens=False)


def test_tree_gives_the_leftmost_lowest():
    rng = random.Random(4)
    merge = lambda i: rng.randint(0, 50) << 40 | i << 20 if rng.random() < 0.7 else bpe.NEVER
    for n in (1, 2, 31, 32, 33, 1000, 1025):
        rows = [[merge(i) for i in range(n)] for _ in range(3)]
        one, many = [bpe.RankTree(list(r)) for r in rows], bpe.RankTrees(np.array(rows))
        for _ in range(200):
            at = [(k, rng.randrange(n)) for k in (0, 1, 2, 1)]
            new = [merge(i) for _, i in at[:3]]
            new.append(new[1] if at[3] == at[1] else merge(at[3][1]))
            for (k, i), v in zip(at, new):
                rows[k][i] = v
                one[k].put(i, v)
            many.put(np.array([k for k, _ in at]), np.array([i for _, i in at]), np.array(new))
            low = [min(r) for r in rows]
            assert [t.root() for t in one] == low == many.roots(np.arange(3)).tolist()
    for n in (1, 2, 5, 64, 100):  # equal merges: the leftmost is next
        row = [rng.randint(0, 3) << 40 for _ in range(n)]
        tree = bpe.RankTree(np.array(row))
        for _ in range(n):
            at = tree.place()
            assert tree.root() == min(row) and at == row.index(min(row))
            row[at] = bpe.NEVER
            tree.put(at, bpe.NEVER)


def test_every_piece_goes_through_a_tree(monkeypatch):
    seen = []
    one, many = bpe.RankTree.__init__, bpe.RankTrees.__init__
    monkeypatch.setattr(bpe.RankTree, "__init__", lambda self, m: (seen.append(1), one(self, m))[1])
    monkeypatch.setattr(bpe.RankTrees, "__init__", lambda self, m: (seen.append(len(m)), many(self, m))[1])
    words = ["ab", "hello", "unbelievable", "x" * 300, "é", "worldwide" * 4]
    ids = token_ids.TokenIds(PATH)
    list(ids.encoded(["a", " ".join(words), " ".join(words)]))
    assert sum(seen) == len(words)  # each piece of two bytes or more once; "a" has no pair


def test_very_long_pieces():
    rng = random.Random(21)
    text = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    raw = next(token_ids.TokenIds(PATH).encoded([text]))
    assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("n", "letters"), [((1 << 20) + 10, "abcdefgh"), (3_000_000, "etaoin"), (400_000, "\u0e01")])
def test_pieces_of_over_a_million_bytes(n, letters):
    """Longer than any place of 20 bits, and followed by pairs that merge at the very end."""
    rng = random.Random(n)
    text = "".join(rng.choice(letters) for _ in range(n)) + "ababab"
    raw = next(token_ids.TokenIds(PATH).encoded([text]))
    assert np.frombuffer(raw, "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_digests(spark, folder):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in token_ids.op4(spark, folder(documents=documents(*AWKWARD))).collect()}
    for i, t in enumerate(AWKWARD):
        ids = TOKENIZER.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(TOKENIZER.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert got[10] == got[11]  # repeated rows
    assert token_ids.op4(spark, folder(documents=([], DOCS))).count() == 0


def check_packed(out, texts, capacity=2048):
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r)
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids = [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(got[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in pieces] == [(k, a, min(capacity, len(ids) - a)) for k, a in enumerate(range(0, len(ids), capacity))]
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length]))
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark, folder):
    texts = [*AWKWARD, *["word " * (37 * i % 1500) for i in range(150)]]
    sf = folder(documents=documents(*texts))
    out = packing.pack(spark, spark.read.parquet(f"{sf}/documents.parquet").repartition(40), PATH).collect()
    n = check_packed(out, texts)
    sizes = [r.length for r in out]
    assert n <= 1.15 * -(-sum(sizes) // 2048)  # forty scraps of a few documents each
    check_packed(packing.op5(spark, sf).collect(), texts)
    twice = [(1, "some words here", "en", "s", 1), (1, "some words here", "en", "s", 1), (None, None, None, None, None), (None, None, None, None, None)]
    out = packing.op5(spark, folder(documents=(twice, DOCS))).collect()
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length) for r in out) == [(0, 0, 0, 1)] * 2 + [(1, 0, 0, out[0].length if out[0].doc_id else max(r.length for r in out))] * 2
    assert sorted(r.offset for r in out)[0] == 0 and len({r.sequence_id for r in out}) == 1
    assert packing.op5(spark, folder(documents=([], DOCS))).count() == 0


def test_best_fit_against_a_plain_one():
    rng = random.Random(6)
    for _ in range(50):
        items = [(rng.randint(1, 100), [(i, 0, 0, 0, 0)]) for i in range(rng.randint(0, 60))]
        bins = []
        for size, p in sorted(items, key=lambda x: (-x[0], x[1][0][0])):
            fit = [b for b in bins if sum(b) + size <= 100]
            if fit:
                max(fit, key=sum).append(size)
            else:
                bins.append([size])
        got = packing.best_fit(items, 100)
        assert len(got) == len(bins) and sorted(b[0] for b in got) == sorted(map(sum, bins))
        assert sorted(p for _, ps in got for p in ps) == sorted(p for _, ps in items for p in ps)


def test_open_bins_wait_for_later_lots():
    rng = random.Random(17)
    sizes = [rng.randint(1100, 1400) for _ in range(20_000)] + [rng.randint(600, 900) for _ in range(20_000)]
    out = list(packing.packed(((n, [(i, 0, 0, n, 0)]) for i, n in enumerate(sizes)), 0, 0, packing.PASSED, 2048, 16))
    fills = [f for b in out for f in b.column(3).to_pylist()]
    assert sorted(p["doc_id"] for b in out for ps in b.column(4).to_pylist() for p in ps) == list(range(40_000))
    assert sum(fills) == sum(sizes) and max(fills) <= 2048
    assert len(fills) <= 1.1 * 20_000


# 6

CHAT = "conv_id long, turn long, role string, text string"


def test_chat(spark, folder):
    long = "x<y#\\s \\h </turn>\n### user:\n" * 300
    talk = [(1, 0, "system", "Be: good."), *[(1, i, ("user", "assistant")[i % 2], f"{i} {long if i % 5 == 0 else 'ok'}") for i in range(1, 200)]]
    talk += [(2, 0, "user", None), (2, 1, "assistant", None), (3, 5, None, "a"), (3, 5, None, "a"), (3, 2, "assistant", "\\l<"), (None, 1, "us:er\n", "q"), (4, None, "user", "first"), (4, 0, "assistant", "next 😀")]
    sf = folder(conversations=(talk, CHAT))
    got = {r.conv_id: r for r in chat.op6(spark, sf).collect()}
    want = {}
    for conv, turn, role, text in talk + [(-7, 0, "user", chat.SAMPLE), (-7, 1, "assistant", chat.SAMPLE)]:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        turns.sort()
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{sf}/conversations.parquet/*.parquet'")
    fields = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert {r[0]: r for r in c.sql(f"select {', '.join(fields)} from ({chat.ORACLE})").fetchall()} == {k: tuple(r[f] for f in fields) for k, r in got.items()}


def plain_windows(turns):
    """Windows of one conversation by plain loops: (repeated, own) as lists of places, in order."""
    size = [len(t[3] or "") // chat.LETTERS + chat.OVERHEAD for t in turns]
    lead = 0 if turns[0][2] == "system" and size[0] <= chat.LEAD else None
    led = size[0] if lead == 0 else 0
    out, blocks = [], {}
    for i, t in enumerate(turns):
        blocks.setdefault((t[1] if t[1] is not None else -(1 << 60)) // chat.BLOCK, []).append(i)
    tail = []
    for b in sorted(blocks):
        seen, fill = list(tail), None
        for i in blocks[b]:
            past, total = [], 0
            for j in reversed(seen):
                if total + size[j] > chat.HISTORY:
                    break
                total, past = total + size[j], [j, *past]
            if led + total + size[i] > chat.BUDGET:
                total, past = 0, []
            if fill is not None and fill + size[i] <= chat.BUDGET:
                fill += size[i]
                out[-1][1].append(i)
            else:
                fill = size[i] + (0 if i == lead else led + total)
                out.append(([] if i == lead or lead is None else [lead], [i]))
                out[-1][0].extend([] if i == lead else past)
            if i != lead:
                seen.append(i)
        tail, total = [], 0
        for turn in sorted({turns[i][1] for i in blocks[b] if turns[i][1] is not None}, reverse=True):
            same = [i for i in blocks[b] if turns[i][1] == turn and not (turns[0][2] == "system" and turn == turns[0][1] and turns[i][2] == "system" and b == min(blocks))]
            if same and total + sum(size[i] for i in same) > chat.HISTORY:
                break
            total += sum(size[i] for i in same)
            tail = same + tail
    return out, size


def test_windows_against_plain_loops(spark):
    rng = random.Random(26)
    talks = []
    for conv in range(40):
        n, big = rng.choice([1, 5, 60, 200]), rng.choice([50, 400, 3000, 12_000])
        first = [(conv, -5, "system", "s" * rng.choice([0, 900, 2016, 2020, 12_000]))] if rng.random() < 0.7 else []
        talks.append(first + [(conv, rng.randint(0, 1 + (conv % 5 == 4)) + 2 * i, rng.choice(["user", "assistant"]), "x" * rng.randint(0, big)) for i in range(n)])
    talks.append([(99, 0, "system", "s" * 12_000), *((99, i, ("user", "assistant")[i % 2], "y" * 700) for i in range(1, 130))])
    got = {}
    for r in chat.formatted(spark.createDataFrame([t for talk in talks for t in talk], CHAT)).collect():
        got.setdefault(r.conv_id, []).append(r)
    for talk in talks:
        talk.sort(key=lambda t: (t[1], t[2], t[3]))
        windows, size = plain_windows(talk)
        rows_ = sorted(got[talk[0][0]], key=lambda r: (r.block, r.window))
        line = lambda i: f"### {talk[i][2]}:\n{talk[i][3]}</turn>\n"  # noqa: B023, E731
        assert [(r.n_repeated, r.n_own, r.formatted) for r in rows_] == [(len(a), len(b), "".join(map(line, a + b))) for a, b in windows]
        for r, (a, b) in zip(rows_, windows):
            assert r.tokens == sum(size[i] for i in a + b)
            assert r.tokens <= chat.BUDGET or r.n_own == 1 and r.n_repeated <= 1
        blocks = {r.block for r in rows_}
        if max(size) <= chat.HISTORY and len(blocks) > 1 and len({t[1] for t in talk}) == len(talk):
            led = talk[0][2] == "system"
            assert all(r.n_repeated >= 1 + led for r in rows_[2:]), talk[0][0]  # the first one may hold the system turn alone
    full = [sum(len(r.formatted) for r in got[99]), len(got[99])]
    assert full[0] / full[1] > 5000  # ordinary windows are filled


def test_chat_windows_and_masks(spark):
    talk = [(1, 0, "system", "Be: good."), *[(1, i, ("user", "assistant")[i % 2], f"{i} <ok> " * 40) for i in range(1, 200)]]
    w = sorted(chat.formatted(spark.createDataFrame(talk, CHAT)).collect(), key=lambda r: (r.block, r.window))
    assert len({r.block for r in w}) == 4 and all(r.formatted.startswith("### system:\nBe: good.</turn>\n") for r in w)
    assert w[0].n_repeated == 0 and all(r.n_repeated >= 2 for r in w[1:])
    for r in w:
        for s in r.loss:
            assert r.formatted[: s.start].endswith("### assistant:\n") and r.formatted[s.start + s.length :].startswith("</turn>\n")
    assert sum(len(r.loss) for r in w) == 100  # each assistant turn once


def test_chat_of_nothing(spark, folder):
    assert [r.conv_id for r in chat.op6(spark, folder(conversations=([], CHAT))).collect()] == [-7]


def test_chat_is_native(spark, folder):
    sf = folder(conversations=([(1, 0, "user", "x")], CHAT))
    assert not re.search("Python|Pandas|Arrow", chat.op6(spark, sf)._jdf.queryExecution().executedPlan().toString())


# 7


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def prose_text(seed, lines=12):
    rng = random.Random(seed)
    return "".join("The " + " ".join("".join(rng.choice("aeinorstl") for _ in range(5)) for _ in range(8)) + ", so.\n" for _ in range(lines))


def test_quality(spark, folder):
    good = prose_text(1)
    texts = [*[t for t in AWKWARD if len(t or "") < 6000], good, good + "All rights reserved\n", "WORD!! " * 60, "a | b | " * 60, "same line here.\n" * 40, "w### x$$$ " * 60, "tie\ntie\n\n tie\n"]
    got = {r.doc_id: r for r in quality.op7(spark, folder(documents=documents(*texts))).collect()}
    for i, t in enumerate(texts):
        n = plain_counts(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n
        assert got[i].base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
    assert [texts[i] for i in sorted(got) if got[i].kept] == [good, good + "All rights reserved\n"]
    shouted = "\n".join(f"{w.upper()}!! {i} {w}{i}X!!" for i, w in enumerate(["ab", "cd", "ef"] * 30))
    assert not quality.judged(shouted)["base_failed"] and not quality.judged(shouted)["kept"]


def plain_fault(line):
    """Whether a line breaks a rule, rule by rule."""
    words = line.split()
    shares = len(words) >= 3
    symbols = sum(c in "#*$%&|<>" for c in line) > 0.1 * sum(map(len, words))
    separators = shares and sum(w in quality.SEPARATORS for w in words) / len(words) > 0.2
    exclaimed = shares and line.count("!") / len(words) > 0.3
    letters = [c for c in line if c.isalpha()]
    shouted = shares and len(letters) >= 10 and sum(c.isupper() for c in letters) / len(letters) > 0.7
    plain = " ".join(re.sub(r"[.,;:!?…()\[\]\"'&/|–—-]", " ", line.lower()).split())
    menu = plain and sum(w in quality.MENU for w in plain.split()) / len(plain.split()) > 0.5
    found = sum(len(m[0]) for w, p in quality.PHRASES.items() if w in plain.split() for m in re.finditer(rf"\b(?:{p})\b", plain))
    unstopped = len(words) >= 60 and not re.search(r"[.,;:!?…。，！？]", line)
    addresses = shares and sum(bool(re.match(r"https?://\S|www\.\S", w)) for w in words) / len(words) > 0.3
    consent = [w for w in plain.split() if w in quality.CONSENT]
    consent = shares and {"cookie", "cookies"} & set(consent) and len(set(consent)) >= 2 and len(consent) >= 0.15 * len(plain.split())
    return symbols or separators or exclaimed or shouted or menu or (found > 0 and found >= 0.1 * len(plain)) or unstopped or addresses or consent


def plain_run_fault(lines, at):
    """Whether a line fails with those around it, by going both ways from it. lines: those with words."""
    stop = lambda x: re.search(r"[.,;:!?…。，！？]", x)
    short = len(lines[at].split()) <= 6
    like = lambda x: not stop(x) and (len(x.split()) <= 6) == short
    if stop(lines[at]):
        return False
    a = b = at
    while a > 0 and like(lines[a - 1]):
        a -= 1
    while b + 1 < len(lines) and like(lines[b + 1]):
        b += 1
    words = " ".join(lines[a : b + 1]).split()
    titled = sum(bool(re.match(r"\d", w)) or w[0].isupper() for w in words)
    return (b - a >= 5 and titled >= 0.5 * len(words)) if short else len(words) >= 60


def plain_verdict(text):
    n, chars, _, _, again = plain_counts(text)
    lost, seen, at = 0, set(), -1
    spoken = [x.strip(quality.SPACES) for x in text.split("\n") if x.strip(quality.SPACES)]
    for line in text.split("\n"):
        at += bool(line.strip(quality.SPACES))
        if words := re.findall(r"[^\x20\x09-\x0D]+", line):
            if plain_fault(line) or (len(line.strip(" \t\n\x0b\x0c\r")) >= 20 and line in seen):
                lost += sum(map(len, words))
            else:
                seen.add(line)
                if plain_run_fault(spoken, at):
                    lost += sum(map(len, words))
    return n >= 50 and 100 * again <= 50 * n and lost <= 0.5 * chars


def test_verdicts_against_plain_rules():
    rng = random.Random(27)
    pieces = ["all rights reserved", "Home", "Login", "|", "»", "wow!", "LOUD WORDS HERE", "a plain sentence, with a stop.", "#$%", "click here", "cookie policy", "Impressum", "read more", "the rest of it", "\n", "\n", "é ü", "one line that comes again and again\n", "tie", "https://x.org/a", "cookies", "settings", "\nTeam\nPricing", "\nAbout us 7\n", "no stop in this longer line of more words\n"]
    kept = 0
    for _ in range(1500):
        text = " ".join(rng.choice(pieces) + (f" {rng.randint(0, 999)}" if rng.random() < 0.5 else "") for _ in range(rng.randint(20, 120)))
        for line in text.split("\n"):
            if line.strip(quality.SPACES):
                assert bool(quality.line_fault(line)) == bool(plain_fault(line)), line
        assert quality.judged(text)["kept"] == plain_verdict(text)
        kept += plain_verdict(text)
    assert 20 < kept < 1400
    long = " ".join(f"word{i}" for i in range(70)) + ", and all rights reserved."
    assert quality.line_fault(long) is None and quality.line_fault("A line that is a little longer than others, all rights reserved, as they say.") == "boilerplate"


NOTICE = [
    "We use cookies to personalise content and ads, to provide social media features and to analyse our traffic.", "You can change your cookie settings at any time in your browser.", "By continuing to use this site you agree to the use of cookies.",
    "Necessary cookies help make a website usable by enabling basic functions.", "Some cookies are placed by third party services that appear on our pages.", "Our partners may use cookies and combine them with other information.",
    "Analytics cookies help us understand how visitors use the website.", "If you reject optional cookies, the site still works.", "Accept all cookies or manage your preferences below.", "Wir verwenden Cookies, um die Nutzung der Webseite zu verstehen; mit Ihrer Einwilligung.",
]


@pytest.mark.parametrize("lines", [
    ["Products / Services / Pricing / Team / Careers", "About / Press / Partners / Blog / Events"] * 3, [f"Section {i} link" for i in range(60)],
    [" ".join(f"word{i}x{j}" for j in range(30)) for i in range(10)], [f"{x} {i}" for i, x in enumerate(NOTICE * 2)], ["https://a.org/x www.b.org/y and more", "see www.c.org or www.d.org"],
    ["Home", "", "Team", "Our Offices", "", "Jobs", "News 2024", "Imprint Page"],
])
def test_shapes_of_boilerplate_fail(lines):
    good = prose_text(3).rstrip("\n").split("\n")
    text = "\n".join(good[:6] + lines + good[6:])
    clean, failed, _ = quality.cleaned(text)
    assert clean.split("\n") == good[:6] + [x for x in lines if not x] + good[6:] and failed == sum(map(bool, lines))
    assert not quality.judged("\n".join(f"{x} {i}" if x else x for i in range(12) for x in lines))["kept"]


def test_verse_lists_and_baking_are_no_boilerplate():
    verse = "\n".join(f"and so the {w} goes on\nand never {w} again" for w in "river wind night rain light".split())
    recipe = "\n".join(f"- a {w} of the best kind" for w in "spoon cup pinch glass slice handful".split())
    baking = "The cookies came out of the oven, and nobody could wait.\nShe baked more cookies, this time with nuts.\nA heading Of Some Words\nThen, text.\nSee www.a.org for all of it, or ask us."
    for text in (verse, recipe, baking):
        assert quality.cleaned(text) == (text, 0, 0)


def test_quality_of_long_and_repeated_texts(spark, folder):
    long = "".join(f"Sentence {i} of it, with {i * 7} words.\n" for i in range(60_000))
    got = {r.doc_id: r for r in quality.op7(spark, folder(documents=documents(long, "x" * 3_000_000, long))).collect()}
    assert got[0].kept and got[0].n_words == 7 * 60_000 and tuple(got[0])[1:] == tuple(got[2])[1:] and got[1].word_chars == 3_000_000 and not got[1].kept
    assert quality.op7(spark, folder(documents=([], DOCS))).count() == 0


def test_quality_stage_keeps_columns(spark):
    body = prose_text(2)
    docs = spark.createDataFrame([(1, body + "Click here\n", "en", "s", 0), (2, "x", "en", "s", 1), (None, body, None, None, None)], DOCS)
    got = {r.doc_id: r for r in quality.quality_stage(docs).collect()}
    assert got.keys() == {1, None} and got[1].text == body and got[1].n_chars == len(body) and got[None].n_chars is None


CLASH = f"{DOCS}, _v string, _p long, _print string, _stays double, place int, row long, node string, root string, _V_ string"


def test_stages_leave_other_columns_alone(spark):
    body = prose_text(3)
    extra = ("v", 7, "print", 0.5, 3, 4, "n", "r", "V")
    data = [(i, t, lang, "s", len(t), *extra) for i, (t, lang) in enumerate([(body, "en"), (body, "en"), (prose_text(4), "en"), (prose_text(5) + "Click here\n", None)])]
    docs = spark.createDataFrame([*data, (None, None, None, None, None, *(None for _ in extra))], CLASH)
    stages = {"quality": quality.quality_stage(docs), "language": langid.language_stage(spark, docs), "near_dedup": simhash.near_dedup(spark, docs)}
    for name, out in stages.items():
        assert out.columns == docs.columns and out.schema == docs.schema, name
        rows_ = out.collect()
        assert len(rows_) == {"quality": 4, "language": 4, "near_dedup": 4}[name], name
        assert all(tuple(r)[5:] == extra for r in rows_ if r.doc_id is not None), name
        empty = {"quality": quality.quality_stage, "language": lambda d: langid.language_stage(spark, d), "near_dedup": lambda d: simhash.near_dedup(spark, d)}[name]
        assert empty(docs.where("false")).count() == 0, name


# 8


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps):
    low = {f: f for f in fps}

    def find(f):
        while low[f] != f:
            f = low[f]
        return f

    for a in low:
        for b in low:
            if a < b and (a ^ b).bit_count() <= 4:
                low[find(a)] = find(b)
    return {f: find(f) for f in low}


def near(fp, rng, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        fp ^= 1 << b
    return fp


def test_no_link_is_lost(spark):
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    fps |= {near(f, rng, 6) for f in list(fps) for _ in range(20)}
    signed = {f: f - 2**64 if f >= 2**63 else f for f in fps}
    got = rows(simhash.linked(spark.createDataFrame([(s,) for s in signed.values()], "fp long")), "a", "b")
    want = {(signed[a], signed[b]) for a in fps for b in fps if signed[a] < signed[b] and (a ^ b).bit_count() <= 4}
    assert set(got) == want and len(got) <= 2.5 * len(want)


def test_links_are_never_broadcast(spark, tmp_path):
    """A small table of fingerprints has many keys, which Spark's estimate of its size doesn't show."""
    spark.range(50).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/nodes")
    plan = simhash.linked(spark.read.parquet(f"{tmp_path}/nodes"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_golay_code():
    rng = np.random.default_rng(9)
    words = rng.integers(0, 1 << 22, 500)
    index = simhash.indices(words)
    assert set((index >= 0).sum(1).tolist()) <= {1, 6}
    for d in (1, 2):
        other = words.copy()
        for i in range(len(other)):
            for b in rng.choice(22, d, replace=False):
                other[i] ^= 1 << int(b)
        theirs = simhash.indices(other)
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(index, theirs))
        if d == 1:
            assert all(a[0] in b for a, b in zip(index, theirs))


def test_components(spark):
    rng = random.Random(10)
    chain = [(i, i + 1) for i in range(100, 160)]
    links = chain + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(-5, 500 + i) for i in range(50)]
    links = [(a, b) for a, b in links if a != b]
    low = {x: x for e in links for x in e}
    for _ in range(len(low)):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    assert dict(rows(components(spark, spark.createDataFrame(links, "a long, b long")), "node", "root")) == low
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(spark, folder):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(300)] for _ in range(8)]
    texts = [*[t for t in AWKWARD if len(t or "") < 400]]
    for b in base:
        for _ in range(6):
            w = list(b)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(300)] = rng.choice(vocabulary)
            texts.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    data, schema = documents(*texts)
    data += [(3, texts[3], "en", "s", 1), (None, texts[-1], "en", "s", 1)]
    out = simhash.op8(spark, folder(documents=(data, schema))).collect()
    assert len(out) == len(data)
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    group = plain_groups(set(fps.values()))
    low = {}
    for i, f in fps.items():
        low[group[f]] = min(low.get(group[f], i), i)
    for r in out:
        i = len(texts) - 1 if r.doc_id is None else r.doc_id
        assert (r.fingerprint, r.component_id) == (f"{fps[i]:016x}", low[group[fps[i]]])
    docs = spark.createDataFrame(data, schema)
    kept = [r.doc_id for r in simhash.near_dedup(spark, docs).collect()]
    assert sorted(kept) == sorted(low.values())
    assert simhash.op8(spark, folder(documents=([], DOCS))).count() == 0


def test_fingerprints_of_long_texts(spark, folder):
    rng = random.Random(28)
    words = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(70_000)]
    texts = [" ".join(words), "\n".join(words).upper(), " ".join(words[:-1]), "y" * 2_000_000]
    out = {r.doc_id: r for r in simhash.op8(spark, folder(documents=documents(*texts))).collect()}
    assert [out[i].fingerprint for i in range(4)] == [f"{plain_fingerprint(t):016x}" for t in texts]
    assert out[1].component_id == 0 and out[3].component_id == 3


def test_dedup_takes_rows_of_one_group_only(spark):
    a, b, c, d, e = (prose_text(seed) for seed in range(30, 35))
    data = [(1, a), (None, a), (None, b), (None, b), (None, c), (5, a), (5, d), (7, d), (8, e), (8, e), (9, None), (9, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = simhash.near_dedup(spark, docs).collect()
    kept = sorted(((r.doc_id, r.text) for r in got if r.doc_id != 9), key=str)
    assert kept == sorted([(1, a), (None, b), (None, c), (5, d), (8, e)], key=str)
    assert sum(r.doc_id == 9 for r in got) == 1


def test_dedup_deals_its_links_out(spark, tmp_path, monkeypatch):
    """The pipeline's stage, whose fingerprints are few bytes and whose keys are many rows."""
    plans, write = {}, simhash.written

    def noted(session, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(session, df, name)

    monkeypatch.setattr(simhash, "written", noted)
    texts = [prose_text(seed) for seed in range(40, 44)]
    spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    kept = simhash.near_dedup(spark, spark.read.parquet(f"{tmp_path}/docs"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3]
    assert "SortMergeJoin" in plans["pairs"] and "Broadcast" not in plans["pairs"]


# 9


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(12).integers(0, 2**63, 3000).astype(np.uint64)
    for n in (1, 2, 7, 16, 17, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_shards(spark, folder):
    data, schema = documents(*AWKWARD, *[f"text {i}" for i in range(400)])
    data += [data[3], (None, "n", None, None, None), (None, "n", None, None, None)]
    out = sharding.op9(spark, folder(documents=(data, schema))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in out) == sorted((d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in data)
    by = {}
    for r in out:
        assert r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) == 16
    assert len({r.shard for r in out if r.doc_id is None}) == 1


def test_a_hot_key_is_numbered_by_the_tasks_that_read_it(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5).alias("doc_id"), F.col("id").alias("shard"), F.lit("s").alias("slot"), F.lit(1).alias("place")).repartition(7)
    out = sharding.sharded(spark, docs, 4)
    assert out.columns == ["doc_id", "shard", "slot", "place", "shard_", "grown_shard", "slot_"]
    by, of = {}, {}
    for r in out.collect():
        by.setdefault(r.shard_, []).append(r.slot_)
        of.setdefault(r.doc_id, set()).add((r.shard_, r.grown_shard))
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(len(x) == 1 for x in of.values())
    assert sorted(r["shard"] for r in out.collect()) == list(range(4000))
    assert sharding.sharded(spark, docs.where("false"), 4).count() == 0


def test_shards_of_nothing(spark, folder):
    assert sharding.op9(spark, folder(documents=([], DOCS))).count() == 0


# 10


def speech(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_language(spark, folder):
    rng = random.Random(13)
    alphabets = {"aa": "aeioulmnr", "bb": "bdgkoptu", "cc": "çéèàusrt"}
    texts, langs = [], []
    for i in range(300):
        lang = sorted(alphabets)[i % 3]
        other = sorted(alphabets)[(i + 1) % 3]
        texts.append(speech(rng, alphabets[lang], 60) + (" " + speech(rng, alphabets[other], 20) if i % 4 == 0 else ""))
        langs.append(lang)
    texts += [None, "", "123 ²½ !!", "x" * 3000, speech(rng, alphabets["bb"], 20_000), texts[0]]
    langs += ["aa", None, "aa", None, None, None]
    out = {r.doc_id: r for r in langid.op10(spark, folder(documents=documents(*texts, langs=langs))).collect()}
    assert len(out) == len(texts)
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [i for i in range(300) if out[i].held_out]
    assert sum(out[i].lang_pred == langs[i] for i in held) >= 0.97 * len(held)
    assert [out[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and out[304].lang_pred == "bb"
    assert (out[305].lang_pred, out[305].score) == (out[0].lang_pred, out[0].score)
    unlabelled = langid.op10(spark, folder(documents=documents("some text", None, langs=[None, None]))).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)] * 2


ALPHABETS = {"aa": "aeioulmnr", "bb": "bdgkoptu", "cc": "çéèàusrt"}


def test_words_of_mixed_texts_are_labelled():
    rng = random.Random(29)
    tagger = langid.Tagger(langid.fitted([(lang, speech(rng, letters, 100)) for lang, letters in ALPHABETS.items() for _ in range(60)]))
    right = total = 0
    for _ in range(30):
        parts = [(lang, speech(rng, ALPHABETS[lang], rng.randint(15, 60))) for lang in rng.sample(sorted(ALPHABETS), 2)]
        want = [lang for lang, t in parts for _ in t.split()]
        got = tagger.word_labels("12, " + " ".join(t for _, t in parts) + " ²!")
        assert [w for w, _ in got] == " ".join(t for _, t in parts).split()
        right += sum(a == b for (_, a), b in zip(got, want))
        total += len(want)
    assert right >= 0.93 * total
    assert tagger.word_labels("1 2 3") == [] and tagger.word_labels("") == []


def test_the_fit_climbs_the_likelihood():
    """Each learned weight's gradient is near zero where training ends, against numeric differences of the plain likelihood."""
    rng = random.Random(30)
    pieces = [(lang, speech(rng, letters, 48)) for lang, letters in list(ALPHABETS.items())[:2] for _ in range(8)]
    model = langid.fitted(pieces)

    def likelihood(m):
        out = 0.0
        for lang, text in pieces:
            e = langid.emissions(text.split(), m.weights.astype(float), m.lexicon)[0]
            a = e[0]
            for x in e[1:]:
                a = np.logaddexp.reduce(a[:, None] + m.moves, axis=0) + x
            k = m.langs.index(lang)
            out += e[:, k].sum() + m.moves[k, k] * (len(e) - 1) - np.logaddexp.reduce(a)
        return out / sum(len(t.split()) for _, t in pieces)

    flat = model._replace(weights=np.zeros_like(model.weights), moves=np.zeros_like(model.moves))
    assert likelihood(flat) < -0.6 and likelihood(model) > -0.05


def test_passages_cover_whole_texts(spark):
    texts = ["".join(chr(97 + i % 26) for i in range(k * 700)) + " end" for k in range(1, 40)]
    docs = spark.createDataFrame([(i, t, ("xx", "yy", None)[i % 3]) for i, t in enumerate(texts)] + [(100, "", "xx"), (101, None, "yy"), (None, "zz", "xx")], "doc_id long, text string, lang string")
    everything = langid.sample(docs, per_lang=10_000, passage=50)
    whole = {lang: sum(-(-len(t) // 50) for i, t in enumerate(texts) if ("xx", "yy", None)[i % 3] == lang and zlib.crc32(str(i).encode()) % 4 != 2) for lang in ("xx", "yy")}
    assert {lang: sum(a == lang for a, _ in everything) for lang in whole} == whole and max(len(p) for _, p in everything) == 50
    some = langid.sample(docs, per_lang=40, passage=50)
    assert len(some) <= 160 and {lang for lang, _ in some} == {"xx", "yy"}
    assert langid.sample(docs.where("lang is null")) == []


def test_every_language_is_learned(spark, folder, monkeypatch):
    """More languages than any small number, each with a few documents, all of them predicted."""
    rng = random.Random(31)
    alphabet = lambda k: "".join(chr(0x4E00 + 12 * k + j) for j in range(12))
    texts, langs = [], []
    for i in range(90 * 6):
        texts.append(speech(rng, alphabet(i % 90), 20))
        langs.append(f"l{i % 90:02d}")
    monkeypatch.setattr(langid, "ROUNDS", 12)
    out = langid.op10(spark, folder(documents=documents(*texts, langs=langs))).collect()
    learned = {lang for i, lang in enumerate(langs) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(learned) > 64 and {r.lang_pred for r in out} == learned
    assert sum(r.lang_pred == langs[r.doc_id] for r in out) >= 0.97 * len(out)


def test_lots_of_sentences_add_up(monkeypatch):
    rng = random.Random(32)
    pieces = [(lang, speech(rng, letters, 80)) for lang, letters in ALPHABETS.items() for _ in range(20)]
    whole = langid.fitted(pieces)
    monkeypatch.setattr(langid, "LOT", 24 * 3 * 7)  # seven sentences at a time
    lots = langid.fitted(pieces)
    assert np.allclose(whole.weights, lots.weights, atol=1e-4) and np.allclose(whole.moves, lots.moves, atol=1e-6)


def test_languages_of_ties_repeats_and_nothing(spark, folder):
    same = "mama papa mama papa"
    texts, langs = [same] * 12, ["bb", "aa"] * 6
    out = langid.op10(spark, folder(documents=documents(*texts, langs=langs))).collect()
    assert len({(r.lang_pred, r.score) for r in out}) == 1 and out[0].score <= 1
    tagger = langid.Tagger(langid.Model(["aa", "bb"], np.zeros(((1 << langid.BITS) + 2, 2), np.float32), np.zeros((2, 2)), {}))
    assert list(tagger.predicted([same, "1"])) == [("aa", 0.5), ("und", 0.0)]  # the language that sorts first
    assert langid.op10(spark, folder(documents=([], DOCS))).count() == 0


def test_every_letter_of_a_long_run_counts():
    rng = random.Random(16)
    learned = [(lang, speech(rng, letters, 60)) for lang, letters in (("aa", "aeioulmnr"), ("bb", "bdgkptwz")) for _ in range(40)]
    tagger = langid.Tagger(langid.fitted(learned))
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [run("aeioulmnr", 40) + run("bdgkptwz", 4000), run("bdgkptwz", 40) + run("aeioulmnr", 100_000)]
    assert [lang for lang, _ in tagger.predicted(texts)] == ["bb", "aa"]
    assert all("".join(langid.WORD.findall(t)) == t for t in texts)


def test_marginals_against_one_long_chain():
    rng = np.random.default_rng(14)
    langs = ["a", "b", "c"]
    model = langid.Model(langs, rng.normal(size=((1 << langid.BITS) + 3, 3)).astype(np.float32), rng.normal(size=(3, 3)), {})
    words = ["".join(rng.choice(list("abcde"), 4)) for _ in range(40)]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 2, 63, 64, 65, 200, 129)]
    tagger = langid.Tagger(model)
    got = tagger.marginals(tagger.rows(texts))
    go = np.exp(model.moves)
    for t, m in zip(texts, got):
        e = [np.exp(langid.emissions([w], model.weights, {})[0][0].astype(float)) for w in t.split()]
        a, b = [np.full(3, 1 / 3)], [np.ones(3)]
        for x in e:
            v = (a[-1] @ go) * x
            a.append(v / v.sum())
        for x in e[:0:-1]:
            v = go @ (x * b[-1])
            b.append(v / v.sum())
        g = np.array([x * y for x, y in zip(a[1:], b[::-1])])
        assert np.allclose(m, (g / g.sum(1, keepdims=True)).mean(0), atol=1e-9)


def test_tables_on_the_way_are_deleted(spark):
    def left():
        where = pathlib.Path(common.shared_dir(spark).removeprefix("file://")) / "lexloom"
        return sorted(p.name.rsplit("-", 1)[0] for p in where.iterdir()) if where.exists() else []

    before = left()
    docs = spark.createDataFrame([(i, prose_text(i % 7)) for i in range(30)], "doc_id long, text string")
    assert simhash.near_dedup(spark, docs).count() == 7
    v = spark.createDataFrame([(i, [float(i % 13), 1.0]) for i in range(300)], "vec_id long, embedding array<double>")
    assert ann.search(spark, v).count() == 30
    new = left()
    for name in before:
        new.remove(name)
    assert sorted(new) == ["ann-found", "marked", "names"]  # what the two results read
    seen = []
    since = common.mark()
    other = threading.Thread(target=lambda: seen.append(common.written(spark, docs, "other")[0]))
    other.start()
    other.join()
    common.cleared(spark, since)
    assert seen[0].count() == 30


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        set = dict.__setitem__

    session = lambda **conf: type("S", (), {"conf": Conf({"spark." + k.replace("_", "."): v for k, v in conf.items()})})()
    assert common.shared_dir(session(checkpoint_dir="hdfs:///x", master="yarn")) == "hdfs:///x"
    assert common.shared_dir(session(master="local[4]")).startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master=master))


def test_nothing_else_imports_this_subpackage():
    import lexloom

    top = pathlib.Path(lexloom.__file__).parent
    assert not [p for p in top.rglob("*.py") if "llm" not in p.parts and re.search(r"lexloom[.]llm|from lexloom import llm", p.read_text())]
