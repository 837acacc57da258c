"""The reader of HTML and selectors over its events."""

import random

import pytest

from quillon.sources import html
from quillon.sources.markup import events
from quillon.sources.select import compiled, find, inside


def kinds(text):
    return [(k, t or d) for k, t, d in events(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a<b>c</b>", [("text", "a"), ("start", "b"), ("text", "c"), ("end", "b")]),
        ("<!DOCTYPE html><!-- <p> --x-->t<![CDATA[<q>]]>", [("text", "t")]),
        ('<p title="a > b" x=\'<\'>&lt;&eacute;&copy&nope;</p>', [("start", "p"), ("text", "<é©&nope;"), ("end", "p")]),
        ("<script>if (a < b) '</p>'</script >x", [("start", "script"), ("text", "if (a < b) '</p>'"), ("end", "script"), ("text", "x")]),
        ("<TITLE>a <b> &amp;</Title>", [("start", "title"), ("text", "a <b> &"), ("end", "title")]),
        ("1 < 2 <3", [("text", "1 "), ("text", "< 2 "), ("text", "<3")]),
        ("<style>x", [("start", "style"), ("text", "x"), ("end", "style")]),
        ("<!-- open", []),
        ("<p", [("text", "<p")]),
        ("a < b<i>", [("text", "a "), ("text", "<"), ("text", " b"), ("start", "i")]),
        ('<a "b>c</a>', [("text", "c"), ("end", "a")]),
        ("", []),
    ],
)
def test_events(text, want):
    assert kinds(text) == want


def test_reading_takes_time_in_proportion():
    for piece in ("<a ", '<a "', "<p>", "</i>", "<!", "&", "<b><p>", "<div class='x'>"):
        list(events(piece * 20_000))
    assert find("<b>" * 20_000 + "</i>" * 20_000 + "<div>" * 20_000 + "<p>x", {"p": "p"})["p"][0].attributes == {}
    assert find("<b>" * 300 + "</i>" * 20_000 + "<div>" * 100 + "<p>x", {"p": "div p"})["p"][0].text == "x"


PAGE = '<div class="list big" id="top"><ul><li>1<li class="z">2 <b>two</b></ul><ul><li>3</ul></div><ul><li data-x="pre-one">4</ul><img src=a><p>q<p>r'


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("li", ["1", "2 two", "3", "4"]), (".list li", ["1", "2 two", "3"]), ("#top > ul > li:nth-child(2)", ["2 two"]), ("div > li", []), ("ul:nth-child(2) li", ["3", "4"]), ("li:first-child", ["1", "3", "4"]),
        ("[data-x^=pre]", ["4"]), ('li[data-x$="one"]', ["4"]), ("[data-x*='e-o']", ["4"]), ("[data-x|=pre]", ["4"]), ("div.list.big b", ["two"]), (".big .z, p", ["2 two", "q", "r"]), ("*[src]", [""]), ("div ul li b", ["two"]), ("div div", []),
    ],
)
def test_selectors(selector, want):
    assert [m.text for m in find(PAGE, {"x": selector})["x"]] == want


@pytest.mark.parametrize("selector", ["a:hover", "a + b", "> a", "a[", "a >", ""])
def test_unknown_selectors_are_errors(selector):
    with pytest.raises(ValueError):
        compiled(selector)


def test_selectors_equal_a_walk_over_random_trees():
    rng = random.Random(4)

    def grow(depth, counter):
        out = []
        for _ in range(rng.randrange(4) if depth else 0):
            counter[0] += 1
            n = counter[0]
            out.append((rng.choice(["div", "section", "ul"]), rng.choice(["a", "b", "a b", ""]), n, grow(depth - 1, counter)))
        return out

    def text(tree):
        return "".join(f'<{t} class="{c}" n="{n}">{text(k)}</{t}>' for t, c, n, k in tree)

    for _ in range(60):
        tree = grow(5, [0])
        for selector in ("div", ".a .b", "div > .a", "section .a > ul", ".a.b", "div ul:nth-child(2) > *", "div div div"):
            got = [int(m.attributes["n"]) for m in find(text(tree), {"x": selector})["x"]]

            def walk(nodes, chain):
                found = []
                for nth, (t, c, n, kids) in enumerate(nodes, 1):
                    here = [*chain, (t, {"class": c}, nth)]
                    parts = compiled(selector)

                    def fits(at, k):
                        p, (tag, own, place) = parts[at], here[k]
                        return p.tag in (None, tag) and p.nth in (None, place) and all(v in own["class"].split() for _, _, v in p.tests)

                    def ends(k, at):
                        if not fits(at, k):
                            return False
                        if at == 0:
                            return True
                        return (k > 0 and ends(k - 1, at - 1)) if parts[at - 1].then_child else any(ends(j, at - 1) for j in range(k))

                    found += [n] if ends(len(here) - 1, len(parts) - 1) else []
                    found += walk(kids, here)
                return found

            assert got == walk(tree, [])


def test_matches_within_an_element():
    got = find("<div><p>a</p></div><p>b</p>", {"d": "div", "p": "p"})
    assert [m.text for m in inside(got["d"][0], got["p"])] == ["a"]


# --------------------------------------------------------------- pages


def test_nested_items_and_paragraphs_of_the_label(spark):
    figure = '<section><figure id="sid-1"><p>1</p><p>2</p><p><a href="/user/wrong/">x</a></p><figcaption><label><p>t<p>by<p><b><a href="/user/ann/gallery">x</a></b></label></figcaption></figure></section>'
    outside = figure.replace("section", "main").replace("ann", "outside")
    rows = spark.createDataFrame([(0, figure + outside), (1, None), (2, "")], "page long, html string")
    assert [tuple(r) for r in html.favourites_page(rows).collect()] == [(0, 0, "ann")]
    item = '<div class="flex-watchlist"><div class="flex-item-watchlist"><div><div>1</div></div><a href="/user/a%20b/">x</a></div></div><div class="flex-item-watchlist"><a href="/user/no/">x</a></div>'
    assert [tuple(r) for r in html.watchlist_page(spark.createDataFrame([(1, item)], "page long, html string")).collect()] == [(1, 0, "a%20b")]


def test_a_failing_page_ends_its_list_and_is_counted(spark):
    fav = lambda u: f'<section><figure id="sid-1"><figcaption><label><p>1<p>2<p><a href="/user/{u}/">x</a></label></figcaption></figure></section>'
    watch = lambda u: f'<div class="flex-watchlist"><div class="flex-item-watchlist"><a href="/user/{u}/">x</a></div></div>'
    schema = "page long, html string"
    favourites = spark.createDataFrame([(0, fav("a")), (1, None), (2, fav("b"))], schema)
    watchlist = spark.createDataFrame([(1, watch("c")), (2, watch("d")), (3, ""), (4, None)], schema)
    rows, errors = html.scanned_lists(favourites, watchlist)
    assert sorted(r["username"] for r in rows.collect()) == ["a", "c", "d"]
    assert sorted(map(tuple, errors.collect())) == [(0, 1), (1, 0)]
    rows, errors = html.scanned_lists(spark.createDataFrame([(0, None)], schema), watchlist)
    assert sorted(r["username"] for r in rows.collect()) == ["c", "d"]
    assert sorted(map(tuple, errors.collect())) == [(0, 1), (1, 0)]


def test_gallery_keeps_empty_tags_and_decodes(spark):
    figures = "".join(f'<figure id="sid-{n}"><a href="/v/{n}?a=1&amp;b=2"><img {"" if n == 2 else f"""data-tags="{"" if n == 3 else "a &amp; b"}" """}></a></figure>' for n in range(1, 14))
    data = '{"1": {"title": "T", "date_fuzzy": "soon"}, "3": {"title": "U", "date_full": "Jan 5, 2024 03:04 PM"}}'
    page = f'<div id="gallery-latest-submissions">{figures}</div><script id="js-submissionData">{data}</script>'
    rows = html.gallery(spark.createDataFrame([("u", page), ("v", page.replace("gallery-latest", "other")), ("w", None)], "url string, html string"), "https://x").orderBy("pos").collect()
    assert [r["id"] for r in rows] == ["1", *map(str, range(3, 11))]
    assert (rows[0]["tags"], rows[0]["item_url"], rows[0]["title"], rows[0]["date_raw"]) == ("a & b", "https://x/v/1?a=1&b=2", "T", None)
    assert (rows[1]["tags"], rows[1]["title"], rows[1]["event_time"].hour) == ("", "U", 15)


def test_journals_end_at_the_limit(spark):
    page = f'<div class="user-submitted-links"> {"long " * 2000}</div><span class="js-displayName"> A &amp; B </span>'
    row = html.profile_pages(spark.createDataFrame([("https://x/user/ann", page)], "url string, html string")).first()
    assert row["journal"] == ("long " * 2000)[: html.JOURNAL_LIMIT] and row["display_name"] == "A & B" and row["bio"] == ""


def test_submission_pages(spark):
    page = f'<div class="submission-title"><h2><p> T &amp; U </p></h2></div><span class="popup_date" title="Jan 5, 2024 03:04 PM">old</span><div class="submission-description">{"d" * 1200}</div><section class="tags-row"><a> fox </a><a>red</a></section>'
    row = html.submission_pages(spark.createDataFrame([("i", page)], "item_url string, html string")).first()
    assert (row["title"], row["tags"], len(row["description"]), row["event_time"].minute) == ("T & U", "fox, red", 1000, 4)
