"""URL rules, source mixing, page text and chat repair: against brute force and worked pages."""

import collections
import random

import pytest

from millrace.llm import chat, html, mixing, queries, urls

FOLDER = "/root/testdata/sf0.001"


def test_url_edge_cases(spark):
    rows = [(1, "http://A.Example.COM/x?q#f", 1), (2, None, 2), (3, "no scheme", 3), (4, "ftp://com", 4), (5, "http://com/", 5), (6, "x://y://net/es/", 6),
            (7, "http://notcom/", 7), (8, "http://a.net/es/1", 8), (8, "http://a.net/es/1", 8), (9, "http://example.com/en/?a", 9), (10, "http://..com/", 10), (11, "://", 11)]
    df = spark.createDataFrame(rows, "page_id long, url string, host int")
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, rules).select("_llm_row.page_id", "host", "path", "rule", "verdict").collect())
    assert got == sorted([
        (1, "a.example.com", "/x", "com/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "com", "", None, "allow"),
        (5, "com", "/", "com/", "allow"), (6, "y:", "//net/es/", None, "allow"), (7, "notcom", "/", None, "allow"), (8, "a.net", "/es/1", "net/es/", "block"),
        (8, "a.net", "/es/1", "net/es/", "block"), (9, "example.com", "/en/", "example.com/en/", "block"), (10, "..com", "/", "com/", "allow"), (11, "", "", None, "allow")],
        key=lambda r: (r[0],))
    assert urls.allowed(df, rules).columns == df.columns and urls.allowed(df, rules).count() == 9
    assert urls.judge(df.limit(0), rules).count() == 0 and urls.allowed(df, rules.limit(0)).count() == len(rows)


def test_long_lists_give_the_same(spark, monkeypatch):
    rng = random.Random(0)
    names = [".".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    pages = spark.createDataFrame([(i, f"http://{rng.choice(names)}/{rng.choice('xyz')}/{i % 5}") for i in range(400)], "page_id long, url string")
    listed = sorted({(rng.choice(names), rng.choice(["/", "/x", "/y/1"])) for _ in range(40)})
    rules = spark.createDataFrame([(h, p, rng.choice(["allow", "block"])) for h, p in listed], "host string, path string, verdict string")
    pick = lambda: sorted(map(tuple, urls.judge(pages, rules).select("_llm_row.page_id", "rule", "verdict").collect()), key=str)
    small = pick()
    monkeypatch.setattr(urls, "SMALL_LIST", 0)
    assert pick() == small
    by = {(h, p): v for h, p, v in rules.collect()}
    for page, url in pages.collect():
        host, path = url[7:].split("/", 1)
        fits = [h + p for h, p in by if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        assert next(s[1] for s in small if s[0] == page) == (max(fits, key=lambda f: (len(f), f)) if fits else None)


def test_mixing_comes_near_targets(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op3_mix_sources"](spark, folder).collect()
    sources = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source").collect())
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    for r in rows:
        taken[sources[r.doc_id]] += r.taken
        target[sources[r.doc_id]] = r.target
        largest[sources[r.doc_id]] = max(largest[sources[r.doc_id]], r.size)
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sum(target.values()) == pytest.approx(sum(r.size for r in rows))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = dict(mixed.groupBy("doc_id").count().collect())
    assert all(times.get(r.doc_id, 0) * r.size == r.taken for r in rows)


def test_water_filling_clamps_in_rounds(spark):
    rows = [("a", 100, 100.0), ("b", 100, 30.0), ("c", 1000, 1.0), (None, 1000, 1.0), ("e", 0, 5.0)]
    sources = spark.createDataFrame(rows, "_llm_source string, _llm_source_size long, _llm_weight double")
    got = {r[0]: r[3] for r in mixing.water_fill(sources).collect()}
    assert got == {"a": 300.0, "b": 300.0, "c": 800.0, None: 800.0, "e": 0.0}
    assert mixing.water_fill(sources, budget=1e9).agg({"_llm_target": "sum"}).first()[0] == 6600.0


def test_mixing_edge_cases(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, "a b c", None), (3, "a b c", None), (None, "d e", "t")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, copies int")
    got = mixing.copies(df).collect()
    assert len(got) == 5 and sum(r.target for r in {(r.source_size, r.target): r for r in got}.values()) == pytest.approx(8)
    assert mixing.mix(df).columns == df.columns
    assert mixing.copies(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    weights = spark.createDataFrame([("t", 1.0)], "source string, weight double")
    assert {r.doc_id: r.copies for r in mixing.copies(df, weights).collect()}[None] == 3


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="top"><a href="/">Site</a></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div class="cookie-notice">We use cookies here. <button>OK</button></div>
<div class="layout"><div class="sidebar"><h3>Related</h3><ul><li><a href="/r">Other story</a></li></ul></div>
%s<h1>The  heading &amp; more</h1><p>First paragraph, with <a href="/l">a link</a> and <b>bold&nbsp;words</b>; it goes on for a while.
<p>Second paragraph.<br>It has a second line, and it also goes on for some while.<script>var t="</p>";</script></p>
<ul><li>A first point.</li><li>A second point.</li></ul><div class="ad">Buy this!</div>%s
<div class="comments"><h3>Comments</h3><p>I liked this article a lot, thank you for writing it all up.</p><form><input><label>Name</label></form></div></div>
<footer>&copy; Site. All rights reserved.</footer></body></html>"""
TEXT = "\n".join([
    "The heading & more", "First paragraph, with a link and bold words; it goes on for a while.",
    "Second paragraph. It has a second line, and it also goes on for some while.", "A first point.", "A second point."])


@pytest.mark.parametrize("opened, closed", [
    ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<section id="main"><article>', "</article></section>")])
def test_a_page_of_every_part(opened, closed):
    model = html.trained([PAGE % ("<article>", "</article>")] * 20)
    assert html.texts([PAGE % (opened, closed)], model) == [TEXT]


def test_pages_of_the_table(spark):
    import html as entities
    import re

    pages = dict(spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html").collect())
    got = {r.page_id: r for r in queries.QUERIES["op6_html_text"](spark, FOLDER).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        inner = re.search("<article>(.*?)(</article>|$)", page, re.S)[1]
        blocks = re.split("</?(?:h1|p)>", inner)
        want = "\n".join(filter(None, (" ".join(entities.unescape(re.sub("<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in blocks)))
        assert got[i].text == want and got[i].n_chars == len(want), i


def test_page_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "plain text"), (4, "<"), (5, "<p>" * 3000 + "deep"), (6, "<div>" * 3000 + "deep"), (7, "</p></div><article>a &lt;b&gt; &#x41;<!-- x --></article")]
    df = spark.createDataFrame([(i, "u", h, 1) for i, h in rows], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in html.extracted(df).collect()}
    assert got[1] == got[2] == "" and "a <b> A" in got[7]
    assert html.extracted(df.limit(0)).count() == 0


def legal(roles):
    if roles[:1] == ["system"]:
        roles = roles[1:]
    return len(roles) % 2 == 0 and len(roles) > 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles))


def brute_cost(roles):
    """Least cost over all choices of role, merge or insertion for each turn."""
    best = float("inf")
    todo = [((), 0.0, 0)]
    found = {}
    while todo:
        last, cost, i = todo.pop()
        key = (last, i)
        if found.get(key, float("inf")) <= cost:
            continue
        found[key] = cost
        if i == len(roles):
            for tail, price in (((), 0), (("assistant",), 3), (("user", "assistant"), 6)):
                if legal([*last, *tail]):
                    best = min(best, cost + price)
            continue
        for role in chat.ROLES[1:]:
            price = 0.0 if role == roles[i] else 2.0
            if last and last[-1] == role:
                todo.append((last, cost + price + 1, i + 1))
            for inserted in ((), ("user",), ("assistant",)):
                made = [*last, *inserted, role]
                if legal(made) or legal([*made, "assistant"]) or made == ["system"]:
                    todo.append((tuple(made), cost + price + 3 * len(inserted), i + 1))
    return best


def test_repair_costs_are_least(spark):
    rng = random.Random(5)
    convs = [[rng.choice(["system", "user", "assistant", "assistant", "user", "tool"]) for _ in range(rng.randrange(1, 7))] for _ in range(60)]
    rows = [(c, t, r, f"{c}.{t}") for c, conv in enumerate(convs) for t, r in enumerate(conv)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, place int")
    pieces = chat.formatted(df)
    cost = dict(pieces.groupBy("conv_id").sum("cost").collect())
    assert cost == {c: brute_cost(conv) for c, conv in enumerate(convs)}
    for r in chat.rendered(pieces).collect():
        messages = [m.split("\n", 1) for m in r.text.split(chat.OPEN)[1:]]
        assert legal([m[0] for m in messages]) and r.text.count(chat.CLOSE) == len(messages)
        said = [w for m in messages for w in m[1].replace(chat.CLOSE, "").split()]
        assert said == [f"{r.conv_id}.{t}" for t in range(len(convs[r.conv_id]))]


def test_cut_conversations_cost_the_same(spark):
    rng = random.Random(6)
    roles = [rng.choice(["user", "assistant", "user", "system", None]) for _ in range(3000)]
    df = spark.createDataFrame([(7, t, r, "x") for t, r in enumerate(roles)] + [(1, 0, "user", "y")], "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = dict(chat.formatted(df).groupBy("conv_id").sum("cost").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = chat.span_costs(roles)[chat.START]
    assert got == {7: min(whole[s] + chat.ENDINGS[s][0] for s in range(4)), 1: 3.0}


def test_chat_of_the_table_and_edges(spark):
    given = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    pieces = queries.QUERIES["op1_chat_format"](spark, FOLDER)
    assert pieces.where("action != 'insert'").count() == given.count()
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (2, None, "assistant", None), (3, 1, None, "<|im_end|>"), (4, 1, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.rendered(chat.formatted(df)).collect()}
    assert got[None].cost == 2.0 and got[4].cost == 5.0 and got[2].cost == 3.0 and got[3].text.count("<|im_end|>") == 2
    assert chat.formatted(df.limit(0)).count() == 0
