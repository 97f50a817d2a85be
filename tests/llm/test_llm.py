"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import html as stdlib_html
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cadence.llm import bpe, common, fingerprints, hmm, html, jaccard, kneser, lines, mixing, passages, quality
from cadence.llm import words as W

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [(9_000_001, None), (9_000_002, ""), (9_000_003, "a b"), (9_000_004, "A  b"), (9_000_005, " \t\n"), (9_000_006, "x" * 5000), (None, "no id here at all, really none")]


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def table(spark, rows):
    """With repeated rows and columns whose names clash with those the operators use."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text"), "shard": F.lit(1), "size": F.lit("x"), "_raw": F.lit(2)}).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()] + ODD + [ODD[2]]


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall(low(t or ""))
        sets[d] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {d: d for d in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    order = lambda d: math.inf if d is None else d
    for d, s in sets.items():
        common = Counter(e for x in s for e in where[x] if e != d)
        for e, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)), key=order)
                parent[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_jaccard_brute(spark, rows):
    got = jaccard.join_documents(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_equal_sets_have_equal_digests():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(str(rng.randrange(50)) for _ in range(rng.randrange(40))) for _ in range(200)]
    texts = texts + [f"  {t}" for t in reversed(texts)]
    w = W.split(pa.array(texts))
    owner, key = jaccard.sets(w, 5)
    found = list(zip(*(d.tolist() for d in jaccard.set_digests(owner, key, np.bincount(owner, minlength=len(texts)))), strict=True))
    assert found == found[::-1]
    distinct = {frozenset(key[owner == i].tolist()) for i in range(200)}
    assert len(set(found)) == len(distinct) and len({a for a, _ in found}) == len(distinct)


def brute_links(rows):
    """Per row, in order, the number of other rows it is linked with; and the pairs of rows."""
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t or ""))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    where = defaultdict(list)
    for d, s in enumerate(sets):
        for x in s:
            where[x].append(d)
    out = set()
    for d, s in enumerate(sets):
        common = Counter(e for x in s for e in where[x] if e != d)
        out |= {(min(d, e), max(d, e)) for e, n in common.items() if 100 * n >= 75 * (len(s) + len(sets[e]) - n)}
    return Counter(d for p in out for d in p), {p for p in out if sets[p[0]] != sets[p[1]]}, sets


def test_linked_sets_brute(spark, rows):
    """All links inside components too: near copies of near copies, exact copies, odd and repeated rows."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    near = []
    for d in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        near.append((8_000_000 + d, " ".join(w)))
    rows = rows + near + [(8_500_000 + d, t) for d, t in near[:5]]
    per_row, links = jaccard.linked_sets(table(spark, rows))
    counts, pairs, sets = brute_links(rows)
    got = per_row.collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got), key=key) == sorted(((d, len(sets[i]), counts[i]) for i, (d, _) in enumerate(rows)), key=key)
    named = {r["doc_id"]: r["set_id"] for r in got if r["doc_id"] is not None}
    assert all((named[rows[i][0]] is None) == (not s) for i, s in enumerate(sets) if rows[i][0] is not None)
    want = {tuple(sorted((named[rows[i][0]], named[rows[j][0]]))) for i, j in pairs if rows[i][0] is not None and rows[j][0] is not None}
    found = [(r["a"], r["b"]) for r in links.collect()]
    assert len(found) == len(set(found)) and {tuple(sorted(p)) for p in found} == want


def test_jaccard_near_group(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_documents(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_fingerprints_brute(spark, rows):
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (math.inf if r[0] is None else r[0], r[1]))
    want = Counter()
    for i, (d, t) in enumerate(ordered):
        n = ordered[(i + 1) % len(ordered)][1]
        e = fingerprints.edit(t, n)
        c = fingerprints.canonical
        want[(d, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.digest(c(t)).hex(), fingerprints.digest(c(e)).hex(), float(c(e) == c(t)), float(c(n) == c(t)))] += 1
    got = Counter(tuple(r) for r in fingerprints.fingerprints_with_edits(table(spark, rows)).collect())
    assert got == want


def test_fingerprint_form_and_clash(spark, monkeypatch):
    assert fingerprints.canonical(" Straße ﬁx  Å ") == "strasse fix å"
    monkeypatch.setattr(fingerprints, "digest", lambda form: b"\x01" * 16)  # every digest clashes
    got = fingerprints.fingerprint_frame(table(spark, [(1, "one"), (2, "ONE "), (3, "two")]))
    names = {r["doc_id"]: r["fingerprint"] for r in got.collect()}
    assert len(set(names.values())) == 2 and names[1] == names[2]


def test_bpe_is_the_library(spark, rows):
    t = bpe.table(bpe.model_path())
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "th", "er", "1", "é", "ß", "▁", "中", "😀", "\t", "\x00", "<s>", "▁▁▁", "=", "....", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [" " * k for k in range(40)] + ["a" * 20000]
    for x in texts:
        want = [*t.lib.encode(x), t.end]
        assert t.encode(x) == want and t.decode(t.parts(x)) == t.lib.decode(want)
    got = {r["doc_id"]: r for r in bpe.encode_frame(table(spark, rows), bpe.model_path()).collect()}
    for d, x in rows:
        ids = [*t.lib.encode(x or ""), t.end]
        assert got[d]["ids"] == ids and got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(t.lib.decode(ids).encode()).hexdigest()


def test_quality_base_and_accuracy(spark, small):
    big = small.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    field = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.assess(docs.select("doc_id", "text").union(spark.createDataFrame(ODD, "doc_id long, text string")), field).collect()}
    for d, t in [(r["doc_id"], r["text"]) for r in docs.collect()] + ODD:
        w = WORD.findall(t or "")
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    judged = [(got[d]["kept"], q) for d, q in truth.items() if not got[d]["base_failed"]]
    assert sum(k == bool(q) for k, q in judged) / len(judged) > 0.97
    kept = quality.keep(docs, field)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["kept"]}


def test_field_by_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    k = quality.N_FEATURES
    docs = [(rng.normal(size=(n, k)), rng.integers(0, 2, n), float(rng.random())) for n in (1, 4, 7, 3, 2)]
    theta = rng.normal(size=k + 6)

    def value(t):
        out, (w, pair, start) = 0.0, (t[:k], t[k:-2].reshape(2, 2), t[-2:])
        worth = lambda x, y: start[y[0]] + sum(pair[a, b] for a, b in zip(y, y[1:], strict=False)) + sum(float(r @ w) for r, c in zip(x, y, strict=True) if c)
        for x, y, weight in docs:
            every = [worth(x, z) for z in itertools.product((0, 1), repeat=len(x))]
            out += weight * (worth(x, y.tolist()) - math.log(sum(map(math.exp, every))))
            field = quality.Field(w, pair, start)
            best = quality.viterbi(field, (x @ w).tolist())
            assert worth(x, best) == pytest.approx(max(every))
        return out

    f, g = quality.likelihood(docs, theta, cells=8)
    assert f == pytest.approx(value(theta))
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-5
        assert g[i] == pytest.approx((value(theta + step) - value(theta - step)) / 2e-5, abs=1e-5)
    top = quality.ascend(lambda ts: [quality.likelihood(docs, t) for t in ts], steps=200)
    f, g = quality.likelihood(docs, top)
    assert np.abs(g - 1e-3 * top).max() < 1e-3


def test_labels_change_inside_documents(spark, small):
    """Menus inside prose are found line by line, and lines of both kinds of documents take the label of most."""
    rng = random.Random(12)
    prose = lambda: " ".join(rng.choice(["the", "old", "river", "ran", "slowly", "past", "town"]) for _ in range(14)) + "."
    menu = lambda: " | ".join(rng.choice(["HOME", "LOGIN", "CART", "HELP"]) for _ in range(5)) + " |"
    rows, labels, quoted = [], [], [prose() for _ in range(12)]
    for d in range(240):
        good = d % 2
        own = [((rng.choice(quoted) if rng.random() < 0.5 else prose()) if good else menu()) for _ in range(rng.randint(4, 9))]
        if d % 3:
            own.insert(rng.randrange(len(own)), "ALL RIGHTS RESERVED | 2020 |" if good else rng.choice(quoted))
        rows.append((d, "\n".join(own)))
        labels.append((d, good, 0))
    rows += [(400 + d, "ALL RIGHTS RESERVED | 2020 |\n" + menu()) for d in range(160)]
    labels += [(400 + d, 0, 0) for d in range(160)]
    docs = table(spark, rows)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    taught = quality.line_labels(docs, labels, 1000, 11).collect()
    assert any(len(set(r["y"])) == 2 for r in taught)
    field = quality.train(docs, labels)
    mixed = [prose(), prose(), menu(), menu(), menu(), prose(), "ALL RIGHTS RESERVED | 2020 |", prose()]
    scores = [sum(a * b for a, b in zip(f, field.w, strict=True)) for f in quality.features("\n".join(mixed))[0]]
    assert quality.viterbi(field, scores) == [1, 1, 0, 0, 0, 1, 0, 1]
    again = quality.train(docs.repartition(7), labels)
    assert abs(field.w - again.w).max() < 1e-6


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = table(spark, ODD)
    field = quality.train(df, labels)
    assert all(r["kept"] == (not r["base_failed"]) for r in quality.assess(df, field).collect())


def test_hmm_counts_and_held_out(spark, rows):
    got = hmm.score(table(spark, rows)).collect()
    words = [(d, WORD.findall(low(t or ""))) for d, t in rows]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter(x for d, w in words if not out(d) for x in [*w, "\0end"])
    n, v = sum(c.values()), len(c)
    want = {d: (out(d), len(w) + 1, sum(c[x] > 0 for x in [*w, "\0end"]), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, "\0end"])) for d, w in words}
    for r in got:
        assert tuple(r)[1:5] == want[r["doc_id"]][:4] and r["base_score"] == pytest.approx(want[r["doc_id"]][4], abs=1e-6)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_forward_is_exact():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    first, move, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3)
    seqs = [rng.integers(0, 5, n) for n in (4, 1, 6)]
    got = hmm.forward(np.array([4, 1, 6]), np.concatenate(seqs), first, move, emit)
    for s, g in zip(seqs, got, strict=True):
        total = sum(first[z[0]] * emit[z[0], s[0]] * math.prod(move[a, b] * emit[b, x] for a, b, x in zip(z, z[1:], s[1:], strict=False)) for z in itertools.product(range(3), repeat=len(s)))
        assert g == pytest.approx(math.log10(total))
    a, b, c = hmm.expected(np.array([4, 1, 6]), np.concatenate(seqs), first, move, emit)
    assert a.sum() == pytest.approx(3, rel=1e-5) and b.sum() == pytest.approx(8, rel=1e-5) and c.sum() == pytest.approx(11, rel=1e-5)


def test_baum_welch_is_the_dense_one(spark, docs, monkeypatch):
    """Training over blocks and slices of classes against loops over single sequences; and shares of all words add up."""
    import numpy as np

    from cadence.llm import blocks as B
    from cadence.llm.common import Workspace

    monkeypatch.setattr(hmm, "SLICE", 1000)
    monkeypatch.setattr(B, "LEAST", 5)
    df = docs.limit(60).select("doc_id", "text", (F.col("doc_id") % 4 != 0).alias("train"))
    ws = Workspace(spark, "t")
    blocks = ws.put(B.encode(df, block_bytes=20_000), "blocks")
    _, stats, common = B.exchange(blocks, ws)
    assert len(common) > 20 and len(stats) == B.N_CLASSES + len(common)
    rows = df.collect()
    count = Counter(x for r in rows if r["train"] for x in WORD.findall(low(r["text"] or "")))
    assert len(common) == sum(c >= 5 for c in count.values()) and sorted(stats[B.N_CLASSES :, 0]) == sorted(c for c in count.values() if c >= 5)
    stats[0] = sum(r["train"] for r in rows), 1
    assert stats[:, 0].sum() == sum(count.values()) + stats[0, 0] and (stats >= 0).all()
    seqs = []
    for b in blocks.collect():
        size, hashes = np.frombuffer(bytes(b["sizes"]), np.int32), np.frombuffer(bytes(b["hashes"]), np.uint64)
        ids = B.classes_of(hashes, np.frombuffer(bytes(b["classes"]), np.uint16), common)[B.unpacked_ids(bytes(b["ids"]), len(hashes))]
        seqs += [np.append(x, 0) for x, on in zip(np.split(ids, np.cumsum(size)[:-1]), b["train"], strict=True) if on]
    tokens, k = stats[:, 0].astype(float), 3
    first, move, emit = hmm.start_model(tokens, k, 5)
    for _ in range(2):
        f, m, e = np.full(k, 0.1), np.full((k, k), 0.1), np.full(emit.shape, 0.01)
        for x in seqs:
            x = x.astype(int)
            fwd = np.zeros((len(x), k))
            bwd = np.ones((len(x), k))
            fwd[0] = first * emit[:, x[0]]
            fwd[0] /= fwd[0].sum()
            for t in range(1, len(x)):
                fwd[t] = fwd[t - 1] @ move * emit[:, x[t]]
                fwd[t] /= fwd[t].sum()
            for t in range(len(x) - 2, -1, -1):
                bwd[t] = move @ (emit[:, x[t + 1]] * bwd[t + 1])
                bwd[t] /= bwd[t].sum()
            post = fwd * bwd
            post /= post.sum(1, keepdims=True)
            f += post[0]
            np.add.at(e.T, x, post)
            for t in range(len(x) - 1):
                both = fwd[t][:, None] * move * emit[:, x[t + 1]] * bwd[t + 1]
                m += both / both.sum()
        first, move, emit = f / f.sum(), m / m.sum(1, keepdims=True), e / e.sum(1, keepdims=True)
    got = hmm.train(blocks, tokens, common, states=k, rounds=2)
    for x, y in zip(got, (first, move, emit), strict=True):
        assert np.allclose(x, y, rtol=2e-3, atol=2e-5)


def plain_article(page):
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S).group(1)
    parts = (" ".join(stdlib_html.unescape(re.sub("<[^>]+>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(p for p in parts if p)


@pytest.mark.parametrize("limits", [{}, {"names": False}], ids=["marks", "tree alone"])
def test_html_articles(spark, small, limits):
    pages = spark.read.parquet(f"{small.replace('0.001', '0.01')}/pages.parquet")
    got = {r["page_id"]: r for r in html.extract(pages, **limits).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == plain_article(r["html"]) and got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_style_tree_removes_what_repeats_and_small_places(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    say = lambda n: " ".join(word() for _ in range(n))
    fixed = [say(6) for _ in range(3)]
    rows = [(i, f"http://site.example/{i}", f"<body><div class=top>{fixed[i % 3]}</div><div class=text><p>{say(30)}</p><p>{say(30)}</p></div><div class=end>{fixed[0]}</div></body>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(pages, names=False).collect()}
    for i, _, page in rows:
        assert got[i] == "\n".join(re.findall("<p>(.*?)</p>", page))
    # No article element; wrappers and parts whose names only resemble noise; a teaser article; adverts that never repeat; comments by class.
    rows, want = [], {}
    for i in range(40):
        body = [say(rng.randint(20, 60)) for _ in range(rng.randint(2, 9))]
        share, related = say(12), say(12)
        parts = "".join(f"<p>{p}</p>" for p in body) + f"<div class='share-price'>{share}</div><section id=related-work><p>{related}</p></section>"
        head = say(4)
        rows.append((i, "https://u:p@News.Example:80/a", f"<body class=with-header><div class='layout has-sidebar'><div class=bar>{say(2)}<ul><li>{say(1)}<li>{say(1)}</ul></div><article class=teaser>{say(5)}</article><div class=story><h1>{head}</h1>{parts}<form><label>{say(2)}</label></form></div><div class=promo>{say(6)}</div><div class=comments><p>{say(20)}</p></div></div></body>"))
        want[i] = "\n".join([head, *body, share, related])
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_html_marked_parts_go_whatever_their_size(spark):
    """Long comments, a long aside, a menu on hosts of one page and advert classes that differ by page, all beside a short article; a table, a quote and marked words inside it stay."""
    r = random.Random(17)
    say = lambda k: " ".join(f"w{r.randrange(5000)}" for _ in range(k))
    rows, want = [], {}
    for k in range(40):
        head, first, cells, last = say(4), say(25), [say(1) for _ in range(3)], say(40)
        quote = "a quote that every page of this host has"
        comments = "".join(f"<article class='comment'><p>{say(30)}</p></article>" for _ in range(8))
        menu = "".join(f"<a href='/x'>{say(2)}</a> " for _ in range(40))
        page = f"""<html><body class="header"><nav>{menu}</nav><div class="ad slot-{k}">{say(60)}</div><article><h1>{head}</h1><p>{first} <span class="share">this</span> too</p>
<table><tr><td>{cells[0]}</td><td>{cells[1]}</td></tr></table><blockquote>{quote}</blockquote><p>{last}</p><ul><li>{cells[2]}</li></ul></article><aside><p>{say(240)}</p></aside><section id="comments">{comments}</section><footer>{say(9)}</footer></body></html>"""
        rows.append((k, f"http://{'solo' + str(k) if k >= 30 else 'host' + str(k % 3)}.example/p{k}", page))
        want[k] = "\n".join([head, f"{first} this too", *cells[:2], quote, last, cells[2]])
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    low = html.style_trees(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(len(r["low"]) + len(r["small"]) < 30 for r in low)


def test_html_articles_inside_marked_elements():
    text = lambda page: html.main_text(html.read(page), frozenset())
    assert text("<form><div><p>all of it</p></div></form>") == "all of it"
    assert text("<aside><article><p>only here</p></article></aside><nav>x</nav>") == "only here"
    assert text("<nav>menu</nav><footer>end</footer>") == ""
    assert text("<div class='menu'><p>said</p></div><nav>x</nav>") == "said"
    assert text("<article><p>a</p></article><aside><article>teaser</article></aside>") == "a"
    assert text("<main>" * 50_000 + "x") == "x"


def test_html_defined_cases(spark):
    deep, long = "<div>" * 100_000 + "end", "<body><p>" + "word &amp; " * 500_000 + "</p></body>"
    rows = [(100, None, None), (101, "http://x", ""), (102, "http://x", "<p>a &amp; b<br>c<p>d"), (103, "http://x", "<![x[ foo"), (104, "http://x", "<p>a<![ b"), (105, "http://x", "<p>a</p><![CDATA[<p>x</p>]]><p>b</p>"), (106, "http://x", deep), (107, None, long), (7, "http://x", "<p>one"), (7, "http://x", "<p>two"), (None, "http://x", "<p>one"), (7, "http://x", "<p>one"), (108, "//y", "<body><nav>n</nav><article><header><h1>T</h1><i>by</i></header><p>x<b>y</b></p><aside>s</aside><form>f</form><section class='comments'><p>c</p></section></article></body>"), (109, "//y", "<p>a</x></b></div>b<script>var x = '<p>no</p>'</script><style>p{}</style>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "low": F.lit(1), "node": F.lit(2)})
    out = html.extract(pages).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert (got[100], got[101], got[102], got[105], got[106], got[108], got[109]) == ("", "", "a & b c\nd", "a\nb", "end", "T\nxy", "ab")
    assert got[107] == " ".join(["word &"] * 500_000) and got[104].startswith("a")
    assert sorted((r["text"] for r in out if r["page_id"] in (7, None))) == ["one", "one", "one", "two"]
    rng = random.Random(6)
    bits = ["<", ">", "<p", "</p>", "<!", "<![", "]]>", "<!--", "-->", "<?", "<div class=", "'", '"', "&", "&#", "&#x110000;", "&amp;", "</", "<script>", "</script>", "a", " ", "<li>", "<td>", "<table>", "<ul>", "<h1>", "<header>", "</header>"]
    for _ in range(3000):
        html.main_text(html.read("".join(rng.choice(bits) for _ in range(rng.randint(1, 30)))), frozenset())


def test_passages_planted(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(5000)]
    planted = [[rng.choice(vocab) for _ in range(rng.randint(55, 120))] for _ in range(6)]
    rows, truth = [], defaultdict(list)
    for d in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randint(60, 200))]
        if d % 4 == 0:
            k, at = rng.randrange(6), rng.randrange(len(w))
            p = list(planted[k])
            if d % 8 and len(p) > 80:
                p[40] = "changed"
            w[at:at] = p
            truth[k].append(d)
        rows.append((d, " ".join(w)))
    got = passages.find_passages(table(spark, rows + ODD)).collect()
    need = {d for v in truth.values() for d in v[1:]}
    assert {r["doc_id"] for r in got} == need
    assert all(r["source_id"] < r["doc_id"] and r["end_word"] - r["start_word"] >= 50 for r in got)


def test_passages_among_quoted_pieces(spark):
    """Every run of 50 words that an earlier document holds is in a passage, whatever stands before, between and after, and in any layout."""
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(5000)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = defaultdict(lambda: say(60))
    for c in range(4):
        base, p = 100 * c, say(60)
        for d in (base + 30, base + 60):  # the full copies, among documents that quote 20 words each
            texts[d] = say(rng.randint(0, 40)) + p + say(rng.randint(0, 40))
        for d in [*range(base, base + 30), *range(base + 31, base + 60), *range(base + 61, base + 90)]:
            at = rng.randrange(0, 41)
            texts[d] = say(30) + p[at : at + 20] + say(30)
    rows = [(d, " ".join(w)) for d, w in texts.items()]
    rng.shuffle(rows)
    seen, want = set(), defaultdict(set)
    for d, w in sorted(texts.items()):
        own = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        want[d] = {i for i, r in enumerate(own) if r in seen}
        seen.update(own)
    results = []
    for parts in (1, 3, 40):
        got = [tuple(r) for r in passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()]
        for d, starts in want.items():
            assert all(any(r[0] == d and r[1] < d and r[2] <= i and i + 50 <= r[3] for r in got) for i in starts)
        results.append(sorted(got))
    assert sum(map(len, want.values())) > 40 and results[0] == results[1] == results[2]
    assert len({r[:2] for r in results[0]}) == 4 and all(b == a + 30 for b, a, *_ in results[0])


def quadratic_scores(x, y, k=5):
    out = []
    for j in range(len(x)):
        ways = [out[i] - (x[j] - x[i]) - (y[j] - y[i]) for i in range(j) if 0 < x[j] - x[i] <= passages.MAX_GAP and 0 < y[j] - y[i] <= passages.MAX_GAP]
        out.append(k * passages.WORTH + max(0, *ways, 0))
    return out


def test_chain_fenwick_matches_quadratic():
    import numpy as np

    rng = np.random.default_rng(3)
    for case in range(300):
        size, span = int(rng.integers(1, 60)), int(rng.integers(5, 400))
        pts = {(int(a), int(b)) for a, b in rng.integers(0, span, (size, 2))}  # strays
        for _ in range(case % 4):  # stretches of a diagonal with gaps
            a, b, n = rng.integers(0, span, 3)
            pts |= {(int(a) + s, int(b) + s) for s in range(0, int(n), int(rng.integers(1, 9)))}
        pts = sorted(pts)
        x, y = [p[0] for p in pts], [p[1] for p in pts]
        score, before = passages.chain_scores(x, y)
        assert score == quadratic_scores(x, y)
        for j, b in enumerate(before):
            assert score[j] == 100 + (score[b] - (x[j] - x[b]) - (y[j] - y[b]) if b >= 0 else 0)
        found = passages.chain(np.array(x), np.array(y))
        assert sorted(i for c in found for i in c.tolist()) == list(range(len(x)))
        for c in found:
            dx, dy = np.diff(np.array(x)[c]), np.diff(np.array(y)[c])
            assert ((dx > 0) & (dx <= passages.MAX_GAP) & (dy > 0) & (dy <= passages.MAX_GAP)).all()


def test_chain_keeps_a_passage_beside_a_stray():
    import numpy as np

    for stray in ([], [(302, 10)], [(100, 305)], [(302, 10), (303, 9), (340, 340 - 30)]):
        pts = sorted({(i, i) for i in [*range(0, 196, 5), *range(300, 396, 5)]} | set(stray))
        found = passages.chain(np.array([p[0] for p in pts]), np.array([p[1] for p in pts]))
        spans = [(pts[c[0]], pts[c[-1]]) for c in found if len(c) > 3]
        assert ((0, 0), (195, 195)) in spans and any(b[0] - a[0] >= 95 for a, b in spans if a[0] >= 300)
    ordered = sorted((3 * i, 3 * i + (40 if i > 20 else 0)) for i in range(40))
    x, y = np.array([p[0] for p in ordered]), np.array([p[1] for p in ordered])
    by_tree = passages._tree_chains(x.tolist(), y.tolist(), 5)
    assert sorted(map(tuple, passages.chain(x, y))) == sorted(map(tuple, by_tree))


def test_mix_targets(spark, docs):
    got = mixing.mix(docs.unionByName(spark.createDataFrame([(9_000_001, None, "en", None, 0), (9_000_002, "a b c", "en", None, 5)], docs.schema)), block_words=16)
    rows = got.collect()
    assert Counter(tuple(r) for r in rows) == Counter(tuple(r) for r in got.collect())
    size, target, taken = {}, {}, Counter()
    for r in rows:
        size[r["source"]], target[r["source"]] = r["source_size"], r["target"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, free, rest = {}, set(names), 1.5 * sum(size.values())
    while free:
        share = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share > 2 * size[s]}
        if not over:
            want |= {s: weight[s] * share for s in free}
            break
        want |= {s: 2.0 * size[s] for s in over}
        rest -= sum(2.0 * size[s] for s in over)
        free -= over
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 32


def test_sainte_lague_quotients(spark):
    rng = random.Random(9)
    parts = [("g", i, rng.randint(0, 500)) for i in range(12)]
    df = spark.createDataFrame(parts, "g string, id int, w long").withColumn("seats", F.lit(40).cast("long"))
    got = {r["id"]: r["q"] for r in mixing.sainte_lague(df, ["g"], "w", "seats", "id", "q").collect()}
    best = sorted(((-w / (2 * s + 1), i, s) for _, i, w in parts for s in range(60) if w), key=lambda x: x)[:40]
    assert got == {i: sum(b[1] == i for b in best) for _, i, _ in parts}


def test_kneser_keeps_trusted(spark, small):
    big = small.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.where("toxic = 0").collect()}
    held = labels.where("doc_id % 3 <> 0")  # the rest is judged without having been seen
    got = {r["doc_id"]: r for r in kneser.classify(docs, held).collect()}
    unseen = [(got[d]["kept"], q) for d, q in truth.items() if d % 3 == 0]
    assert sum(k for k, q in unseen if q) / sum(q for _, q in unseen) > 0.97
    assert sum(not k for k, q in unseen if not q) / sum(1 - q for _, q in unseen) > 0.8


def brute_kneser(texts, order):
    """A function that gives a text's log probability, and one for a word's share after some words, by nested dictionaries."""
    pad = lambda t: ["<s>"] * (order - 1) + WORD.findall(t or "") + ["</s>"]
    level = Counter(tuple(s[p - order + 1 : p + 1]) for t in texts if WORD.search(t or "") for s in [pad(t)] for p in range(order - 1, len(s)))
    levels = {order: level}
    for m in range(order - 1, 0, -1):
        levels[m] = Counter(g[1:] for g in levels[m + 1])
    vocab = {g[0] for g in levels[1]}
    d = {m: kneser.discounts([sum(a == k for a in c.values()) for k in (1, 2, 3, 4)]) for m, c in levels.items()}
    total, free = defaultdict(int), defaultdict(float)
    for m, c in levels.items():
        for g, a in c.items():
            total[g[:-1], m] += a
            free[g[:-1], m] += d[m][min(a, 3) - 1]

    def share(context, word, m=order):
        if m == 0:
            return 1 / (len(vocab) + 1)
        ctx = tuple(context[len(context) - m + 1 :])
        lower = share(context, word, m - 1)
        if (ctx, m) not in total:
            return lower
        a = levels[m].get((*ctx, word), 0)
        return (max(0.0, a - d[m][min(a, 3) - 1]) if a else 0.0) / total[ctx, m] + free[ctx, m] / total[ctx, m] * lower

    def text_log(t):
        s = pad(t)
        return sum(math.log(share(s[p - order + 1 : p], s[p])) for p in range(order - 1, len(s)))

    return text_log, share, vocab


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kneser_brute(spark, docs, labels, rows, order, monkeypatch):
    from cadence.llm.common import Workspace

    monkeypatch.setattr(kneser, "HEAD", 50)
    trusted = kneser.trusted_ids(labels)
    ids = {r["doc_id"] for r in trusted.where(F.pmod(kneser._place(23), F.lit(kneser.HELD)) != 0).collect()}
    text_log, share, vocab = brute_kneser([t for d, t in rows if d in ids], order)
    for context in (["<s>"] * 2, ["the", "and"], ["<s>", "The"], ["nowhere", "seen"]):
        assert sum(share(context, w, order) for w in [*vocab, "unseen"]) == pytest.approx(1)
    df = table(spark, rows)
    got = kneser.perplexities(df, trusted, order=order).collect()
    assert len(got) == len(rows)
    want = {d: (len(WORD.findall(t or "")), text_log(t)) for d, t in rows}
    for r in got:
        n, log_p = want[r["doc_id"]]
        assert r["n_words"] == n and (r["perplexity"] is None) == (n == 0)
        if n:
            assert -math.log(r["perplexity"]) * (n + 1) == pytest.approx(log_p, abs=1e-4 * (n + 1))
    ws = Workspace(spark, "t")
    grams, floor = kneser.fit(docs, trusted, ws, order=order)
    model = kneser.hashed(grams, order)
    runs = [sorted(tuple(map(str, r)) for r in kneser.log_shares(df.repartition(k), model, floor, ws, order, k).collect()) for k in (1, 3)]
    assert runs[0] == runs[1]


def test_kneser_without_trusted(spark):
    empty = kneser.classify(table(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(empty) == len(ODD) and all(r["kept"] == (r["n_words"] > 0) for r in empty)


def brute_lines(rows, least=20, equal=1):
    gone, seen, cut = set(), set(), set()
    variants, short = set(), set()
    for d, t in sorted(((d, t) for d, t in rows if d is not None)):
        for k, line in enumerate((t or "").split("\n")):
            line = line.strip(" \t\n\x0b\x0c\r")
            if equal <= len(line) < least:
                if line in short:
                    gone.add((d, k))
                short.add(line)
            if len(line) < least:
                continue
            own = [(line[:p] + line[p + 1 :], p) for p in range(len(line))]
            if line in seen or line in cut or any(v in variants or v[0] in seen for v in own):
                gone.add((d, k))
            seen.add(line)
            variants.update(own)
            cut.update(v for v, _ in own)
    return gone


def test_lines_brute(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randint(18, 30))) for _ in range(30)]

    def change(x):
        r, p = rng.random(), rng.randrange(len(x) + 1)
        return x if r < 0.3 else x[:p] + rng.choice("abx") + x[p:] if r < 0.5 else x[:p] + x[p + 1 :] if r < 0.7 else x[:p] + rng.choice("abx") + x[p + 1 :]

    rows = [(i, "\n".join(change(change(rng.choice(base))) for _ in range(rng.randint(0, 6)))) for i in range(200)] + [r for r in ODD if r[0] is not None]
    gone = brute_lines(rows)
    got = {r["doc_id"]: r for r in lines.dedup_lines(table(spark, rows)).collect()}
    for d, t in rows:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)
        assert got[d]["text"] == want and got[d]["n_removed"] == sum(e == d for e, _ in gone)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i, *[0] * len(b)]
        for j, y in enumerate(b, 1):
            row[j] = min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1)
    return row[-1]


@pytest.mark.parametrize("bound", [0, 1, 2, 3])
def test_lines_within_any_bound(spark, bound):
    rng = random.Random(bound)
    base = ["".join(rng.choice("ab ") for _ in range(rng.randint(6, 11))) for _ in range(9)]

    def change(x):
        for _ in range(rng.randint(0, bound + 2)):
            p = rng.randrange(len(x) + 1)
            x = x[:p] + rng.choice(["", "a", "b", "c"]) + x[p + rng.randint(0, 1) :]
        return x

    rows = [(i, "\n".join(change(rng.choice(base)) for _ in range(rng.randint(0, 3)))) for i in range(60)]
    gone, seen = set(), []
    for d, t in rows:
        for k, line in enumerate(t.split("\n")):
            line = line.strip(" ")
            if len(line) >= 5 and any(distance(line, e) <= bound for e in seen):
                gone.add((d, k))
            if len(line) >= 5:
                seen.append(line)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(table(spark, rows), min_chars=5, max_edits=bound, equal_chars=5).collect()}
    assert got == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows}
    assert all(lines.within(a, b, bound) == (distance(a, b) <= bound) for a in base for b in map(change, base))


def test_short_equal_lines(spark, tmp_path):
    """Equal lines of any length go; near ones only from 20 characters."""
    from cadence.llm import entry

    rng = random.Random(4)
    short = ["Read more", "Subscribe now", "x", "é", "Page 1", "Page 2", "a line of nineteen "]
    rows = [(d, "\n".join([" " * (d % 3) + rng.choice(short) for _ in range(rng.randint(0, 5))] + ["", "".join(rng.choice("abcdefgh") for _ in range(30))])) for d in range(150)]
    seen, gone = set(), Counter()
    for d, t in rows:
        for line in t.split("\n")[:-2]:
            gone[d] += line.strip() in seen
            seen.add(line.strip())
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_removed"] for r in entry.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: gone[d] for d, _ in rows} and sum(got.values()) > 200


@pytest.mark.parametrize("name", ["jaccard", "fingerprints", "bpe", "quality", "hmm", "mix", "lines", "passages", "kneser", "html"])
def test_empty_tables(spark, name):
    df = table(spark, []).withColumn("source", F.lit("s"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    run = {
        "jaccard": lambda: jaccard.join_documents(df),
        "fingerprints": lambda: fingerprints.fingerprints_with_edits(df),
        "bpe": lambda: bpe.encode_frame(df, bpe.model_path()),
        "quality": lambda: quality.assess(df, quality.train(df, none)),
        "hmm": lambda: hmm.score(df, rounds=1),
        "mix": lambda: mixing.mix(df),
        "lines": lambda: lines.dedup_lines(df),
        "passages": lambda: passages.find_passages(df),
        "kneser": lambda: kneser.classify(df, none),
        "html": lambda: html.extract(spark.createDataFrame([], "page_id long, url string, html string")),
    }
    assert run[name]().count() == 0


#: A text over the size at which batches of texts are cut.
LONG = " ".join(f"w{k * 7919 % 100003}" + (".\n" if k % 12 == 0 else "") for k in range(560_000))


def odd_documents(spark, docs):
    """Null and shared ids, equal rows, null and long texts, and columns whose names the stages use themselves."""
    own = [(r["doc_id"], r["text"], r["source"]) for r in docs.limit(60).collect()]
    prose = " ".join(f"Quiet water number {k} went past the old mill." for k in range(30))
    other = " ".join(f"Another tale {k * k} was told beside the winter fire." for k in range(30))
    own += [(None, prose, "a"), (None, prose, "a"), (None, other, None), (7, other + " And more of it.", "b"), (7, prose.upper(), "b"), (8, None, "b"), (9, "", None), (None, None, None), (10, LONG, "a"), (own[0][0], own[0][1], own[0][2])]
    df = spark.createDataFrame(own, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text"), "copies": F.lit("x")})
    for c in ("_copies", "_copy", "_doc", "_drops", "n_lines", "n_removed", "_id", "_t1", "_t2", "size", "taken", "shard", "root", "_place", "won"):
        df = df.withColumn(c, F.lit(c))
    return df.repartition(3)


def test_pipeline_stages_on_odd_rows(spark, small, docs):
    import corpus_pipeline as p

    df = odd_documents(spark, docs).cache()
    rows = df.collect()
    text = lambda rs: Counter((r["doc_id"], r["text"]) for r in rs)
    kept = p.quality_rules(spark, df, small)
    assert kept.columns == df.columns and (None, None) not in text(kept.collect())
    less = p.line_dedup(spark, df, small)
    out = less.collect()
    assert less.columns == df.columns and all(r["n_lines"] == "n_lines" and r["_doc"] == "_doc" for r in out)
    assert sum(r["text"] is None for r in out) == sum(r["text"] is None for r in rows)
    first = p.ngram_jaccard(spark, df, small)
    out = text(first.collect())
    assert first.columns == df.columns
    # By brute force over rows: equal rows count as one, and one of each component stays.
    named = {k: (f"{i:05d}", k[1]) for i, k in enumerate(sorted(text(rows), key=lambda k: (math.inf if k[0] is None else k[0], str(k[1]))))}
    root = {d: r for d, (_, r) in brute_components(list(named.values())).items()}
    for k, (d, t) in named.items():
        if WORD.search(t or ""):
            group = [x for x in named if root[named[x][0]] == root[d]]
            ids = {x[0] for x in group}
            least = min(math.inf if x is None else x for x in ids)
            assert sum(out[x] for x in group) == 1
            assert next(math.inf if x[0] is None else x[0] for x in group if out[x]) == least
        else:
            assert out[k] == text(rows)[k]
    mixed = p.source_mix(spark, df, small)
    out = text(mixed.collect())
    assert mixed.columns == df.columns and all(out[k] <= 2 * n for k, n in text(rows).items()) and set(out) <= set(text(rows))
    assert not any(k[1] is None or not WORD.search(k[1]) for k in out)
    words = lambda c, s: sum(n * len(WORD.findall(t or "")) for (d, t), n in c.items() if s(d))
    total = sum(r["taken"] for r in mixing.mix(df).collect())
    assert abs(words(out, lambda d: True) - total) < 0.6 * max(len(WORD.findall(r["text"] or "")) for r in rows) + 50_000
    none = df.where("false")
    for name, stage in p.STAGES:
        assert stage(spark, none, small).count() == 0, name
    ids = Counter((r["doc_id"], r["n_tokens"]) for r in p.sentencepiece(spark, df.where("length(text) < 5000 or text is null"), small).collect())
    t = bpe.table(bpe.model_path())
    assert ids == Counter((r["doc_id"], len(t.lib.encode(r["text"] or "")) + 1) for r in rows if len(r["text"] or "") < 5000)


def quoted_passages(seed=12, n=30):
    """Passages of 100 words: 12 documents quote 15 to 30 words of each, some before its one full copy and some between three later copies with an edit about every 25 words."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    said = [[r.choice(vocabulary) for _ in range(100)] for _ in range(n)]
    filler = lambda k: [r.choice(vocabulary) for _ in range(k)]

    def quote(p):
        size = r.randint(15, 30)
        at = r.randint(0, 100 - size)
        return p[at : at + size]

    def edited(p):
        out = list(p)
        for at in range(r.randint(8, 20), 100, 25):
            kind = r.choice("sid")
            if kind == "s":
                out[at] = "edit" + out[at]
            elif kind == "i":
                out.insert(at, "more")
            else:
                del out[at]
        return out

    docs, wanted, no = [], [], 0

    def add(words):
        nonlocal no
        docs.append((no, " ".join(filler(20) + words + filler(20))))
        no += 1

    for k in range(12):
        add([w for p in said for w in [*quote(p), *filler(5)]])
    full = {}
    for i, p in enumerate(said):
        full[i] = no
        add(p)
    for k in range(3):
        add([w for p in said[k::3] for w in [*quote(p), *filler(5)]])
        for i, p in enumerate(said):
            wanted.append((no, i))
            add(edited(p))
    return docs, wanted, full


def test_edited_passages_among_quotes(spark):
    """Recall of edited copies whose every piece others quote, against all planted pairs; a copy counts where most of it is found in an earlier copy of the same passage."""
    docs, wanted, full = quoted_passages()
    copies = {full[i]: i for i in full} | dict(wanted)
    got = passages.find_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    found = {(r["doc_id"], copies[r["doc_id"]]) for r in got if r["doc_id"] in copies and copies.get(r["source_id"]) == copies[r["doc_id"]] and r["end_word"] - r["start_word"] >= 80}
    assert len(found & set(wanted)) >= 0.9 * len(wanted)


def test_edited_passages_among_long_quotes(spark):
    """Every edited copy finds its full copy, though others quote each 41 to 49 words of it before and between."""
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(4000)]
    say = lambda k: [r.choice(vocabulary) for _ in range(k)]
    said, docs, full, edited = [say(100) for _ in range(12)], [], {}, {}
    quotes = lambda: [p[at : at + r.randint(41, 49)] for p in said for at in range(0, 60, 7)]
    copies = [[*p[:25], "one", *p[26:50], "two", *p[51:75], "more", *p[75:]] for p in said]
    for words, of in ((quotes(), None), (said, full), (quotes(), None), (copies, edited)):
        for i, w in enumerate(words):
            if of is not None:
                of[i] = len(docs)
            docs.append((len(docs), " ".join(say(20) + w + say(20))))
    got = passages.find_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {(edited[i], full[i]) for i in full} <= {(r["doc_id"], r["source_id"]) for r in got if r["end_word"] - r["start_word"] >= 95}


def test_passages_of_rows_without_ids(spark):
    r = random.Random(5)
    shared = " ".join(f"s{r.randrange(10**6)}" for _ in range(120))
    rows = [(None, f"first {shared}"), (None, f"other {shared}"), (7, f"seven {shared}"), (7, f"more of it {shared}"), (8, "nothing of it")]
    got = [(r["doc_id"], r["source_id"], r["end_word"] - r["start_word"]) for r in passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(7, 7, 120), (None, None, 120), *[(None, 7, 120)] * 4], key=str)  # few holders: with every earlier one


def test_lines_of_rows_without_ids(spark):
    line = "the very same line of thirty-eight chars"
    rows = [(None, f"{line}\none"), (None, f"{line}\ntwo"), (3, f"{line}!\nthree"), (3, f"{line}!\nfour"), (5, "five"), (5, "five")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_no", F.lit(1))
    got = lines.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "_no", "n_lines", "n_removed"]
    texts = sorted(r["text"] for r in got.collect())
    assert sum(line in t for t in texts) == 1 and sum("five" in t for t in texts) == 1
    assert sum(len(t.split("\n")) for t in texts if t) == 6


@pytest.mark.parametrize("name", ["jaccard", "fingerprints", "bpe", "quality", "hmm", "mix", "lines", "passages", "kneser"])
def test_long_texts(spark, docs, labels, name):
    """Texts beyond the size at which batches are cut are read whole, beside others."""
    assert len(LONG) > W.CHUNK_BYTES
    rows = [(1, LONG), (2, "a short one"), (3, LONG + " and an end"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    n = len(WORD.findall(LONG))
    run = {
        "jaccard": lambda: [(r["doc_id"], r["component_id"]) for r in jaccard.join_documents(df).collect()] and sorted(r["component_id"] for r in jaccard.join_documents(df).collect()) == [1, 1, 2, 4],
        "fingerprints": lambda: {r["doc_id"]: r["n_chars"] for r in fingerprints.fingerprints_with_edits(df).collect()} == {d: len(t or "") for d, t in rows},
        "bpe": lambda: {r["doc_id"]: r["decoded_sha256"] for r in bpe.encode_frame(df.where("doc_id <> 3"), bpe.model_path(), with_ids=False).collect()}[1] == hashlib.sha256(bpe.table(bpe.model_path()).lib.decode(bpe.table(bpe.model_path()).lib.encode(LONG)).encode()).hexdigest(),
        "quality": lambda: {r["doc_id"]: r["n_words"] for r in quality.assess(df, quality.train(docs, labels)).collect()} == {1: n, 2: 3, 3: n + 3, 4: 0},
        "hmm": lambda: {r["doc_id"]: r["n_tokens"] for r in hmm.score(df.where("doc_id <> 3"), rounds=1).collect()} == {1: n + 1, 2: 4, 4: 1},
        "mix": lambda: {r["doc_id"]: r["size"] for r in mixing.mix(df).collect()} == {1: n, 2: 3, 3: n + 3, 4: 0},
        "lines": lambda: {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}[3].endswith("and an end"),
        "passages": lambda: [(r["doc_id"], r["source_id"], r["start_word"], r["end_word"]) for r in passages.find_passages(df).collect()] == [(3, 1, 0, n)],
        "kneser": lambda: {r["doc_id"]: r["n_words"] for r in kneser.perplexities(df, df.select("doc_id")).collect()} == {1: n, 2: 3, 3: n + 3, 4: 0},
    }
    assert run[name]()


def test_pipeline_stages(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, small)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        if name == "n-gram Jaccard join":
            want = brute_components([(r["doc_id"], r["text"]) for r in before.collect()])
            assert {r["doc_id"] for r in out.collect()} == {d for d, (_, root) in want.items() if root == d}
        if name == "line dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            gone = brute_lines(rows)
            left = {d: "\n".join(p for k, p in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows}
            assert {r["doc_id"]: r["text"] for r in out.collect()} == {d: left[d] for d, t in rows if left[d] == t or WORD.search(left[d])}
    t = bpe.table(bpe.model_path())
    assert out.count() > 0 and all(t.lib.decode(r["ids"]) is not None and r["n_tokens"] == len(r["ids"]) for r in out.collect())


def test_kneser_learns_from_all_trusted(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"))
    trained = df.where(F.pmod(kneser._place(23), F.lit(kneser.HELD)) != 0).count()
    assert trained > 4500
    grams, _ = kneser.fit(df, df.select("doc_id"), kneser.Workspace(spark, "all"))
    assert grams.where("m = 1 and a > 0").count() == trained + 1  # and the end


def test_put_leaves_no_shuffle_files(spark):
    folder = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {p.name for p in folder.rglob("shuffle_*.data")}
    before, setting = files(), spark.conf.get(common._CLEANUP, None)
    ws = common.Workspace(spark, "put")
    rows = ws.put(spark.range(50_000).repartition(7, "id"), "rows")
    end = time.time() + 20
    while files() - before and time.time() < end:  # removed in the background
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(common._CLEANUP, None) == setting
    assert rows.count() == 50_000


def test_kneser_writes_a_slice_at_a_time(spark, monkeypatch):
    """Many different trigrams: tables together stay near the size of the texts, and all trigrams count."""
    rng = random.Random(5)
    vocab = [f"word{k}" for k in range(3000)]
    texts = [" ".join(rng.choices(vocab, k=400)) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    put, most = common.Workspace.put, []

    def seen(self, rows, name):
        out = put(self, rows, name)
        most.append(sum(f.stat().st_size for f in Path(self.base.removeprefix("file:")).rglob("*.parquet")))
        return out

    monkeypatch.setattr(common.Workspace, "put", seen)
    got = {r["doc_id"]: r["perplexity"] for r in kneser.perplexities(df, df.select("doc_id")).collect()}
    assert max(most) < 2 * sum(map(len, texts))
    ids = {r["doc_id"] for r in df.where(F.pmod(kneser._place(23), F.lit(kneser.HELD)) != 0).collect()}
    text_log, _, _ = brute_kneser([t for d, t in enumerate(texts) if d in ids], 3)
    for d in list(ids)[:5] + [d for d in got if d not in ids][:5]:
        assert -math.log(got[d]) * 401 == pytest.approx(text_log(texts[d]), abs=0.01)


def test_passages_bitmaps_fit_their_seeds(spark):
    import numpy as np

    refs = spark.createDataFrame([(np.arange(1000, dtype=np.uint32).tobytes(),)], "refs binary")
    bits = passages.sized_bitmap(refs, 64)
    assert len(bits) <= 1 << 17 and passages.marked(bits, np.arange(1000, dtype=np.uint64) << np.uint64(32)).all()


def test_passages_steps_by_brute_force():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(50):
        key, owner = rng.integers(0, 40, 200).astype(np.uint64), np.sort(rng.integers(0, 5, 200))
        want = {s + int(np.argmin(key[s : s + 8])) for s in range(193) if owner[s] == owner[s + 7]}
        assert passages.winnowed(key, owner).tolist() == sorted(want)
        size = rng.integers(1, 6, 30)
        cut = np.append(0, np.cumsum(size))
        x, y = (rng.integers(1, 35, cut[-1]).cumsum() - (rng.random(cut[-1]) < 0.1) * 40 for _ in range(2))
        for s, e, one in zip(cut[:-1], cut[1:], passages.single_chains(x, y, cut), strict=True):
            by = np.lexsort((y[s:e], x[s:e]))
            if (by == np.arange(e - s)).all():
                assert one == (len(passages.chain(x[s:e], y[s:e])) == 1 and len(passages.chain(x[s:e], y[s:e])[0]) == e - s)


def test_passages_seeds_are_dealt_evenly(spark):
    """Seeds are least hashes of their windows: dealt by themselves, a shard of low ones held several times the mean."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(2000)) for _ in range(20)]
    docs = spark.createDataFrame([(i, texts[i % 20]) for i in range(40)], "doc_id long, text string")
    sizes = [len(r["refs"]) // 4 for r in passages.seed_matches(docs, 50).where("refs is not null").collect()]
    assert sum(sizes) > 5000 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_passages_couples_in_steps(spark, monkeypatch):
    """A text that repeats itself has thousands of couples: some are held at once, and only those meet that an earlier document holds too."""
    import numpy as np

    rng = np.random.default_rng(6)
    docs = []
    for doc in range(12):
        m = 60
        key = rng.integers(0, 4, m).astype(np.uint64) << np.uint64(60) | np.uint64(doc % 4 if doc < 8 else doc)
        docs.append((doc, key, np.cumsum(rng.integers(1, 9, m)), rng.integers(0, 4, m).astype(np.uint8) & rng.integers(0, 4, m).astype(np.uint8)))
    owner, key, at, flags = (np.concatenate([np.full(60, d[0]) if k == 0 else d[k] for d in docs]) for k in range(4))
    near, far = (50 - passages.K) // 2 + 2, 2 * 50 - passages.K
    want, low, high = set(), {}, {}
    for i in range(len(key)):
        for j in range(i + 1, len(key)):
            if owner[i] == owner[j] and near <= at[j] - at[i] <= far:
                open_ = bool((flags[i : j + 1] & 1).any() and (flags[i : j + 1] & 2).any())
                want.add((i, j, open_))
                couple = (int(key[i]), int(key[j]) >> 32)
                low.setdefault(couple, owner[i])
                if open_:
                    high[couple] = owner[i]
    monkeypatch.setattr(passages, "HELD_COUPLES", 100)
    pieces = list(passages.pairs(owner, key, at, flags, 50))
    assert len(pieces) > 10 and max(len(p[0]) for p in pieces) <= 100
    assert {(i, j, o) for p in pieces for i, j, o in zip(p[0].tolist(), p[1].tolist(), p[3].tolist(), strict=True)} == want
    rows = [(d, k.tobytes(), a.astype(np.int32).tobytes(), k.tobytes(), f.tobytes()) for d, k, a, f in docs]
    held = spark.createDataFrame(rows, "doc long, key binary, at binary, total binary, flags binary").repartition(5)
    got = passages.contested(held, spark.sparkContext.broadcast(np.full(1 << 17, 255, np.uint8)), 50).collect()
    number = {c: int(passages.W.mixed(np.array([c[0]], np.uint64) + np.array([c[1]], np.uint64) * passages._BASE)[0]) >> 32 for c in low}
    found = np.sort(np.concatenate([np.frombuffer(r["refs"], np.uint32) for r in got])).tolist()
    assert found == sorted(number[c] for c in high if low[c] < high[c]) and len(found) < len(low)


def test_passages_steps_keep_a_place_together():
    import numpy as np

    who, size = np.array([0, 0, 0, 1, 2, 2, 5]), np.array([3, 3, 3, 1, 1, 1, 20])
    assert list(passages.steps(who, size, 4)) == [(0, 3), (3, 6), (6, 7)]
    assert list(passages.steps(who, size, 100)) == [(0, 7)] and list(passages.steps(who[:0], size[:0], 4)) == []
