"""Site lines, URL rules and decontamination against plain Python, with the odd cases."""

import collections
import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from ledgerline.llm import components, decontaminate, line_dup, url_filter

PAGES = "page_id long, url string, html string, host string, lines string, component int"
DOCS = "doc_id long, text string, w string, at int"
ITEMS = "item_id long, text string, phrase string"


def _pages(spark, rows):
    return spark.createDataFrame([(k, u, h, "x", "y", 1) for k, (u, h) in enumerate(rows)], PAGES)


# ---- site lines


def test_site_lines(spark):
    menu = "<nav><a href='/'>Home</a></nav>"
    rows = [(f"https://A.example/{k}", f"{menu}<p>Text  {k}\t more</p><script>Home</script><p>Text {k} more</p>") for k in range(12)]
    rows += [("https://b.example/", f"{menu}<p>other</p>")] * 9 + [(None, "<p>Home</p>"), ("https://a.example/x", None), ("https://a.example/y", ""), ("no url", "Home")]
    got = {r.page_id: r for r in line_dup.drop_site_lines(_pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    # 12 of 14 pages of a.example hold the menu; a repeated line of one page counts once
    assert [(got[k].host, got[k].n_lines, got[k].n_dropped, got[k].text) for k in (0, 11)] == [
        ("a.example", 3, 1, "Text 0 more\nText 0 more"), ("a.example", 3, 1, "Text 11 more\nText 11 more")
    ]
    assert all(got[k].n_dropped == 2 and got[k].text == "" for k in range(12, 21))  # nine pages of the same lines
    # pages without a host are one site, and both say the same
    assert [(got[k].host, got[k].n_lines, got[k].text) for k in range(21, 25)] == [("", 1, ""), ("a.example", 0, ""), ("a.example", 0, ""), ("", 1, "")]


def test_share_is_of_all_pages_and_a_tie_keeps(spark):
    rows = [("http://h/", "<p>common</p>" if k < 3 else f"<p>{k}</p>") for k in range(10)]
    got = line_dup.drop_site_lines(_pages(spark, rows), ratio=0.3).collect()
    assert sum(r.n_dropped for r in got) == 0  # three of ten is not above 0.3
    assert sum(r.n_dropped for r in line_dup.drop_site_lines(_pages(spark, rows), ratio=0.29).collect()) == 3
    assert line_dup.drop_site_lines(_pages(spark, [])).collect() == []


def test_hosts_of_any_size(spark):
    rows = [(f"http://h{n}/{k}", f"<p>menu</p><p>text {k}</p>") for n in (1, 2, 3, 9, 10) for k in range(n)]
    for least, treated in ((2, {"h2", "h3", "h9", "h10"}), (3, {"h3", "h9", "h10"})):
        got = line_dup.drop_site_lines(_pages(spark, rows), least_held=least).collect()
        assert len(got) == len(rows) and all(r.n_dropped == (r.host in treated) and ("menu" in r.text) == (r.host not in treated) for r in got)


OPEN_TAGS = ("<script ", "<link ", "<meta ", "<div ", "<!-- ", "<style>", "<", "</p", '<a href="', "<base ")


def test_long_pages_of_tags_that_never_close(spark):
    rows = [(f"http://x.example/{k}", f"<p>start</p>canonical refresh{unit * ((1 << 20) // len(unit))}") for k, unit in enumerate(OPEN_TAGS)]
    pages = _pages(spark, rows).cache()
    assert pages.count() == len(rows)
    for run in (lambda: line_dup.drop_site_lines(pages).count(), lambda: url_filter.judge(pages).count()):
        began = time.perf_counter()
        assert run() == len(rows)
        assert time.perf_counter() - began < 60  # quadratic patterns take hours
    got = line_dup.text_lines(F.col("html"))
    assert [r[0][0] for r in pages.orderBy("page_id").select(got).collect()][0] == "start"
    pages.unpersist()


# ---- components


def test_components_match_union_find(spark):
    rng = random.Random(2)
    for n, m in ((1, 0), (60, 40), (60, 90), (40, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(100, 100 + n)] + [(7, None)]
        up: dict[int, int] = {}

        def root(x, up=up):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in edges:
            if b is not None and a != b:
                x, y = sorted((root(a), root(b)))
                up[y] = x
        want = {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges if None not in e)}
        got = components.connected_components(spark.createDataFrame(edges, "src int, dst int"))
        assert {r.node: r.component for r in got.collect()} == want


# ---- url rules


def _verdicts(spark, rows):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(_pages(spark, rows)).collect()}


def test_rules(spark):
    urls = [
        "http://a.net/x?q", "https://EXAMPLE.net/en/1", "http://www.example.net/de/", "http://example.com/de/x", "http://sub.Example.com/de/", "http://badexample.com/de/", "http://x.org/fr/",
        "http://org/en/", "http://x.net", "mailto:x", "", None, "http://x.org/fr", "x://net/#://y.com/", "http://a.net:80/", "http://example.net/en", "//a.net/", "http://a.net?x/",
    ]
    want = [
        ("a.net", "/x", "net/", "block"), ("example.net", "/en/1", "example.net/en/", "allow"), ("www.example.net", "/de/", "net/", "block"), ("example.com", "/de/x", "example.com/de/", "block"),
        ("sub.example.com", "/de/", "example.com/de/", "block"), ("badexample.com", "/de/", None, "allow"), ("x.org", "/fr/", "org/fr/", "allow"), ("org", "/en/", None, "allow"),
        ("x.net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("x.org", "/fr", None, "allow"), ("net", "/", "net/", "block"),
        ("a.net:80", "/", None, "allow"), ("example.net", "/en", "net/", "block"), ("", "", None, "allow"), ("a.net", "", None, "allow"),
    ]
    got = _verdicts(spark, [(u, None) for u in urls])
    assert [got[k] for k in range(len(urls))] == want
    assert _verdicts(spark, []) == {}


def test_blocks_spread_over_aliases(spark):
    canonical = '<LINK data-x=1 href="{}" rel=\'canonical\'>'
    refresh = '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        ("http://plain.example/1", canonical.format("https://bad.net/a")),  # 0: alias of a blocked page that is no row
        ("http://other.example/2", refresh.format("http://plain.example/1#part")),  # 1: by way of 0, without the fragment
        ("http://third.example/?a=1&b=2", canonical.format("http://other.example/2")),  # 2
        ("http://x.org/fr/1", canonical.format("http://bad.net/b")),  # 3: allowed itself, and so its aliases
        ("http://fourth.example/", canonical.format("http://x.org/fr/1")),  # 4
        ("http://fifth.example/", canonical.format("/relative")),  # 5: no absolute url
        ("http://sixth.example/", canonical.format("http://third.example/?a=1&amp;b=2")),  # 6
        ("http://bad.net/a", None),  # 7
        ("http://seventh.example/", canonical.format("http://good.example/")),  # 8
        ("https://plain.example/1", None),  # 9: another scheme, the same page
    ]
    got = _verdicts(spark, rows)
    assert [got[k][3] for k in range(10)] == ["block", "block", "block", "allow", "allow", "allow", "block", "block", "allow", "block"]
    assert got[0][2] is None and got[7][2] == "net/"


def test_blocks_spread_over_relative_links(spark):
    canonical = '<link rel="canonical" href="{}">'
    refresh = '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        ("https://a.example/x/1?q", refresh.format("//bad.net/a")),  # 0: the page's scheme
        ("http://a.example/x/2", canonical.format("/x/1?q")),  # 1: the page's host, through 0
        ("http://a.example/x/3", refresh.format("2")),  # 2: the page's folder, through 1
        ("http://a.example/y/z/4", canonical.format("../.././x/./3")),  # 3
        ("http://a.example/x/1", refresh.format("?q#part")),  # 4: another query of the page
        ("http://b.example", refresh.format("http://bad.net")),  # 5: no path is /
        ("http://b.example/5", canonical.format("/.")),  # 6
        ("http://c.example/1", '<base href="http://a.example/x/">' + refresh.format("2")),  # 7
        ("http://d.example/1", refresh.format("/go?to=http://bad.net/a")),  # 8: a link in a query is none
        ("http://e.example/1", refresh.format("mailto:x://bad.net/a")),  # 9: no host
        ("http://f.example/de/1", canonical.format("2")),  # 10: 2 is no row
        ("http://example.com/x/1", canonical.format("../de/2")),  # 11: a rule fits where the dots lead
        ("http://example.com/y", refresh.format("/de")),  # 12: and here none
    ]
    got = _verdicts(spark, rows)
    assert [got[k][3] for k in range(13)] == ["block"] * 8 + ["allow"] * 3 + ["block", "allow"]


def test_every_link_counts_but_hidden_ones(spark):
    link, refresh = '<link rel="{}" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        ("http://a.example/0", link.format("canonical", "http://good.example/") + link.format("canonical", "http://bad.net/a")),  # 0: the second of two
        ("http://a.example/1", refresh.format("http://good.example/1") + refresh.format("http://bad.net/a")),  # 1
        ("http://a.example/2", "<!-- " + link.format("canonical", "http://bad.net/a") + " --><p>canonical"),  # 2: in a comment
        ("http://a.example/3", "<script>'" + refresh.format("http://bad.net/a") + "'</script>"),  # 3: in a script
        ("http://a.example/4", link.format("alternate", "http://bad.net/a") + " canonical"),  # 4: another relation
        ("http://a.example/5", link.format("x canonical", "http://bad.net/a")),  # 5: one of several relations
        ("http://a.example/6", '<link data-rel="canonical" data-href="http://bad.net/a">'),  # 6: other attributes
        ("http://a.example/7", '<linkx rel="canonical" href="http://bad.net/a"><a rel="canonical" href="http://bad.net/a">'),  # 7: other tags
    ]
    got = _verdicts(spark, rows)
    assert [got[k][3] for k in range(8)] == ["block", "block", "allow", "allow", "allow", "block", "allow", "allow"]


def test_pages_without_a_host_share_no_alias(spark):
    refresh = '<meta http-equiv="refresh" content="0; url={}">'
    rows = [(None, refresh.format("http://bad.net/a")), ("no url", refresh.format("http://good.example/")), ("http://good.example/", None), (None, refresh.format("/a")), ("", None)]
    got = _verdicts(spark, rows)
    assert [got[k][3] for k in range(5)] == ["allow"] * 5


# ---- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _brute(docs, items, size=10):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = {}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[key]
        listed = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit))
    return out


def test_contamination_matches_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["The", "cat", "sat", "on", "été", "x1", "No", "it", "a", "Ñ"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "-", "  "]) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 5, 9, 10, 11, 25]))) for k in range(14)] + [(14, None), (15, "..."), (16, "cat"), (17, "cat"), (100, "zebra cat"), (18, "CAT, sat")]
    docs = []
    for d in range(80):
        parts = [text(rng.choice([0, 3, 30]))]
        if rng.random() < 0.5:
            parts.append(rng.choice(items)[1] or "")
            parts.append(text(rng.choice([0, 4])))
        docs.append((d, " | ".join(parts)))
    docs += [(200, None), (201, ""), (202, "!!"), (203, "cat"), (204, "cat\x00cat"), (205, "ÉTÉ été")]
    frame = spark.createDataFrame([(d, t, "w", 0) for d, t in docs], DOCS)
    benchmark = spark.createDataFrame([(i, t, "p") for i, t in items + items[:3]], ITEMS)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(frame, benchmark).collect()}
    want = _brute(docs, items)
    assert got == want
    assert {r.doc_id: r.n_near for r in decontaminate.contamination(frame, benchmark).collect()} == _near(docs, items)
    kept = decontaminate.drop_contaminated(frame, benchmark)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, x in want.items() if not x[4])


def _near(docs, items, slop=20, size=10):
    """{doc_id: items of which the two rarest different words of a phrase stand close}."""
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    counts = collections.Counter(x for _, t in docs for x in words(t))
    pairs: dict[tuple, set] = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            rarest = sorted((counts[x], x) for x in set(w[k : k + size]) if counts[x])[:2]
            if len(rarest) == 2:
                pairs.setdefault((rarest[0][1], rarest[1][1]), set()).add(i)
    out = {}
    for d, t in docs:
        at: dict[str, list] = {}
        for k, x in enumerate(words(t)):
            at.setdefault(x, []).append(k)
        found = [ids for (a, b), ids in pairs.items() if any(abs(x - y) <= slop for x in at.get(a, ()) for y in at.get(b, ()))]
        out[d] = len(set().union(*found))
    return out


def test_rows_of_one_id_are_judged_apart(spark):
    docs = [(1, "a b c d e f g h i j"), (1, "z"), (1, "a b c d e f g h i j"), (None, "x a b c d e f g h i j"), (None, None), (2, "c d e f g h i j k l")]
    frame = spark.createDataFrame([(d, t, "w", k) for k, (d, t) in enumerate(docs)], DOCS)
    items = spark.createDataFrame([(7, "a b c d e f g h i j", "p"), (8, "a b c d e f g h i q r s", "p")], ITEMS)
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(frame, items).collect())
    assert got == [(0, 0, 0, 0), (0, 11, 10, 1), (1, 1, 0, 0), (1, 10, 10, 1), (1, 10, 10, 1), (2, 10, 0, 0)]
    assert sorted(r["at"] for r in decontaminate.drop_contaminated(frame, items).collect()) == [1, 4, 5]
    clashing = frame.withColumnsRenamed({"w": "key_a", "at": "row"}).withColumn("terms", F.lit(1))
    kept = decontaminate.drop_contaminated(clashing, items)
    assert kept.columns == clashing.columns and kept.count() == 3


def test_phrase_of_ten_words_must_be_whole_and_in_one_document(spark):
    phrase = "a b c d e f g h i j k"
    docs = [(1, "x a b c d e f g h i j y"), (2, "a b c d e f g h i"), (3, "a b c d e"), (4, "f g h i j k"), (5, "b c d e f g h i j k a b c d e f g h i j")]
    got = {
        r.doc_id: r.n_hit
        for r in decontaminate.contamination(spark.createDataFrame([(d, t, "", 0) for d, t in docs], DOCS), spark.createDataFrame([(1, phrase, "")], ITEMS)).collect()
    }
    assert got == {1: 10, 2: 0, 3: 0, 4: 0, 5: 20}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "", 0)], DOCS), spark.createDataFrame([(1, "a", "")], ITEMS)
    got = decontaminate.contamination(docs, items.limit(0)).collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got] == [(2, 0, 0, False)]
    assert decontaminate.contamination(docs.limit(0), items).collect() == []
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == 1


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "rare b b one", "", 0), (2, "one " + "b " * 40 + "rare", "", 0), (3, "b b b", "", 0)], DOCS)
    found = decontaminate.phrases(spark.createDataFrame([(1, "rare b one", "")], ITEMS))
    got = [(r.doc_id, r.near) for r in decontaminate.proximity_matches(docs, found, slop=20).collect()]
    assert got == [(1, 3)]
    assert decontaminate.proximity_matches(docs, found, slop=50).where(F.col("doc_id") == 2).first().near == 41


def test_proximity_of_a_phrase_with_a_changed_word(spark):
    docs = spark.createDataFrame([(1, "x quick brown wolf y", "", 0), (2, "x y", "", 0)], DOCS)
    found = decontaminate.phrases(spark.createDataFrame([(1, "quick brown fox", ""), (2, "fox", ""), (3, "fox wolf", "")], ITEMS))
    got = [(r.doc_id, r.phrase, r.near_at, r.near) for r in decontaminate.proximity_matches(docs, found).collect()]
    assert got == [(1, ["quick", "brown", "fox"], 2, 1)]  # "brown" comes before "quick"
    assert decontaminate.phrase_matches(docs, found).count() == 0
