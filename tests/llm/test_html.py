"""Extraction on labelled templates with exact texts, against brute-force votes, and on hostile pages."""

import collections
import time

import pytest

from citemill.llm import host_paths

ARTICLE = "<h1>Head line</h1><p>First paragraph with a good many words in it.</p><p>Second one, with &amp; and <b>bold</b> words.</p>"
TEXT = "Head line\n\nFirst paragraph with a good many words in it.\n\nSecond one, with & and bold words."
MENU = "<ul class=menu><li><a href=/a>Home</a><li><a href=/b>News</a></ul>"

TEMPLATES = {
    "wrapper named has-sidebar": f'<body><div class="wrap has-sidebar">{ARTICLE}</div><div class="sidebar"><p>Side text</p></div>',
    "wrapper named no-sidebar": f'<body><div class="content no-sidebar">{ARTICLE}</div><footer>f</footer>',
    "wrapper with a noise name": f'<body><div class="widget">{ARTICLE}</div><div class="ad">Buy now</div>',
    "names that only contain noise words": f'<body><div id="c">{ARTICLE}<p id="market-share">Share.</p><p class="notice-period">Notice.</p></div>',
    "self-closing svg": f'<body><svg/><div class=post>{ARTICLE}</div>',
    "svg with text": f'<body><div class=post>{ARTICLE}<svg><title>icon</title><text>no</text></svg></div>',
    "unclosed iframe": f'<body><div class=top><iframe src=x></div><div class=post>{ARTICLE}</div>',
    "unclosed select": f'<body><div class=top><select><option>A<option>B</div><div class=post>{ARTICLE}</div>',
    "unclosed script": f'<body><div class=post>{ARTICLE}</div><div><script>var a = 1;',
    "page-wide form": f'<body><form action=x><label>Search</label><input name=q><button>Go</button><div class=post>{ARTICLE}</div></form>',
    "small form": f'<body><div class=post>{ARTICLE}<form><p>Mail</p><input></form></div>',
    "menus, notices and comments": f"<body>{MENU}<div class=cookie-notice>We use cookies</div><div class=post>{ARTICLE}</div>"
    "<section id=comments><p>Nice post.</p></section><div class=share-links>Share</div><aside>Also</aside>",
    "comments longer than the article": f"<body><article>{ARTICLE}</article><div id=comments>{'<p>I do not agree with this at all, and so on.</p>' * 20}</div>",
    "unclosed tags": f"<body><div class=post>{ARTICLE.replace('</p>', '').replace('</b>', '</b></i></div2>')}</div></div></div>",
    "comment marks and doctype": f"<!DOCTYPE html><!-- <p>not</p> --><body><main>{ARTICLE}</main><!-- open",
    "header in an article": f"<body><header>Site name</header><article><header>{ARTICLE[:18]}</header>{ARTICLE[18:]}</article>",
    "hidden elements and roles": f'<body><div role=navigation>Menu</div><div class=post>{ARTICLE}<div hidden>no</div></div>',
    "an advert longer than the article": f"<body><div class=ad><p>{'Buy this and buy that now. ' * 20}</p></div><article>{ARTICLE}</article>",
    "an advert longer than a page without an article": f"<body><div class=ad>{'Buy this and buy that now. ' * 20}</div><div class=x>{ARTICLE}</div>",
    "camel case names": f'<body><div class=siteHeader>Top</div><div class=post>{ARTICLE}</div><div class=relatedPosts>More</div>',
}
EXTRA = {"names that only contain noise words": "\n\nShare.\n\nNotice.", "unclosed tags": ""}


@pytest.mark.parametrize("name", TEMPLATES)
def test_templates(name):
    assert host_paths.main_text(host_paths.parse(TEMPLATES[name]), None) == TEXT + EXTRA.get(name, "")


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_each_template_of_a_host_has_its_winner(spark):
    """Menus that look like text stay out on both templates, because the host's pages agree."""
    odd_menu = "<div class=teasers>" + "<p>Read on about things that go on elsewhere, every day.</p>" * 2 + "</div>"
    one = "<body><div class=x><div class=story>%s</div></div>" + odd_menu
    two = "<body><div class=story2><div class=body>%s</div></div>" + odd_menu
    long_ = ARTICLE + "<p>" + "Many more words come here. " * 60 + "</p>"
    rows = [(i, "http://h/", (one if i % 2 else two) % long_) for i in range(20)]
    rows += [(100 + i, "http://h/", (one if i % 2 else two) % ARTICLE) for i in range(2)]
    winners = host_paths.winning_paths(_pages(spark, rows)).collect()
    assert [(r.host, r.paths) for r in winners] == [("h", ["/div.story", "/div.story/div.body", "/div.x", "/div.x/div.story"])]
    found = {r.page_id: r.text for r in host_paths.extract_main_texts(_pages(spark, rows)).collect()}
    assert found[100] == found[101] == TEXT
    assert all(found[i].startswith(TEXT) and "Read on" not in found[i] for i in range(20))
    # Alone, the short pages' own best container is the root.
    alone = host_paths.main_text(host_paths.parse(one % ARTICLE), None)
    assert "Read on" in alone


def test_votes_equal_brute_force(spark):
    rows = [(i, f"http://h{i % 3}/p", TEMPLATES[name]) for i, name in enumerate(sorted(TEMPLATES) * 3)]
    sums, pages = collections.defaultdict(lambda: [0, 0.0, 0]), collections.Counter()
    for i, url, html in rows:
        host, page = url[7:9], host_paths.parse(html)
        pages[host] += 1
        blocks = [b for b in page.blocks if not b.noise]
        weights = [b.weight for b in blocks]
        heading = next((k for k, b in enumerate(blocks) if b.heading), None)
        if heading is not None:
            weights[heading] = max(weights[heading], 0.25 * sum(weights))
        for number, name in enumerate(page.names):
            chain = lambda k: {k} | (chain(page.parents[k]) if k else set())
            share = sum(w for b, w in zip(blocks, weights) if number in chain(b.path)) / sum(weights)
            if share and number:
                vote = sums[host, name]
                vote[0], vote[1] = vote[0] + 1, vote[1] + share
    expected = collections.defaultdict(set)
    for (host, name), (n, share, _) in sums.items():
        if n >= 2 and round(share, 6) >= 0.9 * n and n * 100 >= pages[host]:
            expected[host].add(name)
    assert {r.host: set(r.paths) for r in host_paths.winning_paths(_pages(spark, rows)).collect()} == expected


@pytest.mark.parametrize(
    "html",
    [
        "<div>" * 50_000 + ARTICLE,
        "<div class=a><p>x" * 50_000,
        "<b>" * 50_000 + "</i>" * 50_000 + ARTICLE,
        "<p><div>" + "<span>" * 50_000 + "<div></div>" * 50_000,
        "<script>" * 50_000 + ARTICLE,
        "<div id=n%d>" * 20_000 + "</p>" * 20_000,
        "<a b='" * 20_000,
        "<" * 100_000 + "&" * 100_000,
    ],
    ids=range(8),
)
def test_time_is_bounded(html):
    start = time.process_time()
    page = host_paths.parse(html)
    host_paths.main_text(page, ["/div"])
    assert time.process_time() - start < 20
    assert sum(map(len, page.names)) < 60_000_000


def test_names():
    noise = ["ad", "site-footer", "cookieNotice", "share-links", "comment-list", "sidebar_left", "nav2", "related-posts"]
    plain = ["has-sidebar", "no-sidebar", "market-share", "notice-period", "shadow", "content", "advice", "", "navy", "adobe-reader"]
    assert all(host_paths.noise_name(n) for n in noise) and not any(host_paths.noise_name(n) for n in plain)
