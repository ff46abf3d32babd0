"""Which elements a name takes out of an article."""

import pytest

from tessera.llm import html_wrappers
from tessera.llm.html_wrappers import _drops

FURNITURE = [
    "sidebar with-border", "ad no-print", "ad has-image", "post-ad", "comment-list", "comment-content", "related-posts", "site-header", "nav-menu", "cookie-banner",
    "share-buttons", "sponsored-content", "article__ad--top", "sidebar-left", "skip-to-content", "login-box", "reply-form", "newsletter-form", "social-media-links",
]
ARTICLE = ["related-work", "social-impact", "has-sidebar", "content-with-sidebar", "no-comments", "with-ad", "share-price", "story-body", "image-caption", "search-results", "main", "p-0"]


@pytest.mark.parametrize("names", FURNITURE)
def test_names_of_furniture(names):
    assert _drops(f"div class={names}")


@pytest.mark.parametrize("names", ARTICLE)
def test_names_inside_articles(names):
    assert not _drops(f"div class={names}")


def test_names_decide_inside_articles(spark):
    html = "<body><article><h1>Head</h1><p>One.</p>" + "".join(f'<div class="{n}">drop {k}</div><p class="{a}">keep {k}</p>' for k, (n, a) in enumerate(zip(FURNITURE, ARTICLE, strict=False))) + "</article></body>"
    pages = spark.createDataFrame([(k, f"http://a.example.com/{k}", html) for k in range(3)], "page_id long, url string, html string")
    want = "\n".join(["Head", "One.", *(f"keep {k}" for k in range(len(ARTICLE)))])
    assert {r.text for r in html_wrappers.extract(pages).collect()} == {want}
