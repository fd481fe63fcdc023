"""Unwanted elements inside articles and wrappers."""

import random
import re

import pytest

from ledgerloom.llm import html_text

A = "First, a paragraph of some length, with commas, that reads like an article, and goes on, for a while."
B = "Second, after what is unwanted, with commas too, and words enough, to count as one, by all means."


@pytest.mark.parametrize("tag", ["div", "span", "section"])
def test_an_unwanted_element_closes_nothing_else(tag):
    unwanted = f'<{tag} class="ad">x<{tag}>y</{tag}></{tag}>'
    assert html_text.main_text(f"<{tag} class=page><article><p>{A}</p>{unwanted}<p>{B}</p></article></{tag}>") == f"{A} {B}"
    assert html_text.main_text(f"<body><{tag} class=content><p>{A}</p>{unwanted}<ul><li>one</ul><p>{B}</p></{tag}></body>") == f"{A} one {B}"


@pytest.mark.parametrize("wrapper", ['div class="content has-sidebar"', 'div class="site no-sidebar"', 'section class="post share-enabled"', 'div id="search-result-page"', 'div class="post comments-open"'])
def test_a_wrapper_with_an_unwanted_word_is_kept(wrapper):
    tag, side = wrapper.split()[0], '<div class="sidebar"><p>Side text that is long enough to count.</p></div>'
    assert html_text.main_text(f"<body><{wrapper}><p>{A}</p><p>{B}</p>{side}</{tag}></body>") == f"{A} {B}"
    assert html_text.main_text(f"<body><{wrapper}><article><p>{A}</p></article>{side}</{tag}></body>") == A


@pytest.mark.parametrize("unwanted", ['<p class="advert">Buy this.', "<p hidden>Not to be seen.</p>", '<ul><li>one<li class="cookie-notice">We use cookies.<li>two</ul>'])
def test_unwanted_paragraphs_and_items_are_left_out(unwanted):
    between = "one two " if "<ul>" in unwanted else ""
    assert html_text.main_text(f"<article><p>{A}</p>{unwanted}<p>{B}</p></article>") == f"{A} {between}{B}"


@pytest.mark.parametrize("tag", ["div", "section"])
def test_what_follows_an_unwanted_element_stays_in_the_article(tag):
    page = f'<{tag} class=page><article><p>{A}</p><p>{A}</p><p>{A}</p><{tag} class="ad">x</{tag}><p>Short, but the article\'s own end.</p></article></{tag}>'
    assert html_text.main_text(page) == f"{A} {A} {A} Short, but the article's own end."


WRAPPERS = ('<form id="aspnetForm">{}</form>', '<div class="page with-sidebar">{}</div>', '<div class="overflow-hidden">{}</div>', '<div id="social-app">{}</div>', '<div class="market-share">{}</div>', '<div class=alert-level>{}</div>', "<nav><a href=x>menu</a><div>{}</div>", "<head><title>t</title>{}", '<div class="sidebar"><main>{}</main></div>')


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_a_wrapped_page_is_whole(wrapper):
    assert html_text.main_text(wrapper.format(f"<p>{A}</p><p>{B}</p>")).removeprefix("menu ") == f"{A} {B}"


def test_what_is_beside_the_article_goes():
    for beside in ('<div class="reader-feedback"><p>I liked this article, really, it was very good.</p></div>', '<div class="related"><article><p>Teaser of another article, short and nice.</p></article></div>', "<form><p>Sign up for our news letter, now, please do.</p><input></form>"):
        assert html_text.main_text(f"<body><article><p>{A}</p><p>{B}</p></article>{beside}</body>") == f"{A} {B}"
        assert html_text.main_text(f"<article><p>{A}</p>{beside}<p>{B}</p></article>") == f"{A} {B}"


def test_references_stay_and_link_lists_go():
    references = "<ol><li>Smith, J. (2019). <a href=x>On the origin of the long titles of papers</a><li>Jones, K. (2020). <a href=y>A reply to the origin of the long titles</a></ol>"
    links = "<ul><li><a href=x>Sport</a><li><a href=y>Money</a></ul>"
    text = html_text.main_text(f"<article><p>{A}</p>{links}<p>{B}</p>{references}</article>")
    assert text == f"{A} {B} Smith, J. (2019). On the origin of the long titles of papers Jones, K. (2020). A reply to the origin of the long titles"


CLASSES = ["", "ad", "comments", "page with-sidebar", "story ad", "story comments", "market-share", "article-ad", "js-comments-area", "alert", "share", "discussion", "reader-opinions", "story discussion", "notice", "site-notice-bar", "lead notice"]


def _refusal(tag, cls):
    """(share of the page's text up to which it is refused, form that it needs) by the words of each name of a class."""
    share = 0.5 if tag == "form" else 0.0
    strong, weak, form = html_text._BAD, html_text._WEAK, html_text._FORM
    hits, whole = set(), True
    for name in cls.split():
        words = re.findall("[a-z]+", name)
        marks = {w for w in words if w in strong or w in weak}
        out = bool(marks) and not any(w in html_text._AROUND for w in words) and (any(w in strong for w in words) or all(w in weak or w in form for w in words))
        hits |= marks if out else set()
        whole = whole and out
    if tag in ("body", "main") or not hits or tag == "article" and not hits & html_text._COMMENT:
        return share, ""
    needs = "row" if hits & html_text._ROW else "short"
    if share or any(w not in html_text._SHORT and w not in html_text._ROW for w in hits):
        needs = ""
    return (2.0 if whole else 0.9 if hits & html_text._COMMENT else 0.5), needs


def _random_tree(rng, depth=0):
    tag = rng.choice(["div", "div", "section", "p", "p", "a", "nav", "form", "footer", "header", "ul", "main"] if depth else ["body"])
    if tag == "main" and rng.random() < 0.5:
        tag = "article"
    cls = rng.choice(CLASSES) if rng.random() < 0.3 and tag not in ("a", "body", "main", "article") else ""
    if tag in ("p", "a"):
        return tag, cls, [" ".join(rng.choice(["alpha", "beta,", "gamma", "delta"]) for _ in range(rng.randrange(1, 40 if tag == "p" else 6)))]
    kids = [_random_tree(rng, depth + 1) for _ in range(rng.randrange(1, 6))] if depth < 4 else [("p", "", ["the end"])]
    if tag == "ul":
        kids = [("li", "", [k if k[0] == "a" else "item of a list"]) for k in kids]
    return tag, cls, kids


def _written(n):
    return n if isinstance(n, str) else f'<{n[0]} class="{n[1]}">' + "".join(map(_written, n[2])) + f"</{n[0]}>"


def _slow_main_text(tree):
    """The rules by plain recursion: everything is measured anew wherever it is asked for."""
    kids = lambda n: [k for k in n[2] if not isinstance(k, str)]
    walk = lambda n: [n] + [x for k in kids(n) for x in walk(k)]
    text = lambda n: n if isinstance(n, str) else "".join(map(text, n[2]))
    links = lambda n: len(text(n)) if n[0] == "a" else sum(map(links, kids(n)))
    anchors = lambda n: 1 if n[0] == "a" else sum(map(anchors, kids(n)))
    own = lambda n: len(text(n)) - links(n)
    density = lambda n: links(n) / len(text(n)) if text(n) else 0.0

    def certain(n, inside=False):
        out = []
        for k in n[2]:
            if not isinstance(k, str):
                if k[0] in ("nav", "footer") or (k[0] == "header" and not inside) or (k[0] in ("p", "li") and _refusal(k[0], k[1])[0] and not _refusal(k[0], k[1])[1]):
                    continue
                k = certain(k, inside or k[0] in ("article", "main"))
            out.append(k)
        return n[0], n[1], out

    def alike(n):
        inner = [k for k in kids(n) if k[0] not in ("h1", "h2")]
        return max([sum(x[:2] == k[:2] for x in inner) for k in inner if k[0] != "p" or k[1]], default=0), inner

    def formed(n, needs):
        if needs == "short":
            return own(n) < 160 or links(n) > 0.3 * len(text(n))
        if needs == "row":
            most, inner = alike(n)
            if most < 2 and len(inner) == 1:
                most, inner = alike(inner[0])
            return most > 1 and most > len(inner) / 2
        return True

    def doubtful(n, most):
        out = []
        for k in n[2]:
            if not isinstance(k, str):
                share, needs = _refusal(k[0], k[1])
                holds = any(x is not k and x[0] in ("main", "article") and own(x) >= 0.3 * most for x in walk(k))
                if share and not holds and own(k) <= share * most and formed(k, needs):
                    continue
                k = doubtful(k, most)
            out.append(k)
        return n[0], n[1], out

    root = ("html", "", [certain(tree)])
    root = doubtful(root, own(root))
    nodes, parent = [root], {}
    for n in nodes:
        for k in kids(n):
            parent[id(k)] = n
            nodes.append(k)

    def points(n):
        total = 0.0
        for x in nodes:
            size = len(text(x))
            if size < 25 or x[0] not in ("p", "li") and not (x[0] in ("div", "section", "article", "main", "body", "html") and any(isinstance(k, str) and len(k.strip()) >= 25 for k in x[2])):
                continue
            up, level = parent.get(id(x)) if x[0] in ("p", "li") else x, 1
            while up is not None and level <= 4:
                if up is n:
                    total += (1 + text(x).count(",") + min(size / 100, 3)) / {1: 1, 2: 2, 3: 9, 4: 12}[level]
                up, level = parent.get(id(up)), level + 1
        return total

    worth = lambda n: points(n) * (1 - density(n))
    judged = nodes
    for tag in ("main", "article"):  # the latter wins
        tops = [n for n in nodes if n[0] == tag and not any(n is not o and o[0] == tag and any(x is n for x in walk(o)) for o in nodes)]
        if len(tops) == 1:
            sizes = [len(text(x)) for x in walk(tops[0]) if x[0] == "p" and len(text(x)) > 80 and density(x) < 0.25]
            if len(sizes) > 1 or sum(sizes) > 400:
                judged = [n for n in nodes if any(x is n for x in walk(tops[0]))]
    best = max(judged, key=worth)
    if points(best) <= 0:
        kept = [root] if density(root) < 0.5 else []
    else:
        kept, around = [best], parent.get(id(best))
        if around is not None:
            near = lambda k: worth(k) >= max(10.0, 0.2 * worth(best)) or (k[0] == "p" and (len(text(k)) > 80 and density(k) < 0.25 or text(k) and not links(k)))
            kept = [k for k in kids(around) if k is best or near(k)]
        for tag in ("article", "main"):
            up = best
            while up is not None and up[0] != tag:
                up = parent.get(id(up))
            if up is not None:
                if density(up) < 0.5 and (best is up or around is up or any(k is up for k in kept) or 2 * sum(map(own, kept)) >= own(up)):
                    kept = [up]
                break

    def shown(n, chosen=False):
        if isinstance(n, str):
            return n
        if not chosen and links(n) and n[0] in ("ul", "div", "section") and (density(n) > 0.9 or density(n) > 0.5 and len(text(n)) < 40 * anchors(n)):
            return ""
        inner = "".join(map(shown, n[2]))
        return inner if n[0] == "a" else f" {inner} "

    return " ".join("".join(shown(n, True) for n in kept).split())


def test_random_trees_against_plain_recursion():
    rng = random.Random(11)
    for _ in range(400):
        tree = _random_tree(rng)
        assert html_text.main_text(_written(tree)) == _slow_main_text(tree), _written(tree)


PROSE = "Paragraph {} of the article has many words, with commas, and it goes on for a good while so that it counts as prose."
COMMENT = '<div class="c" id="c{0}"><b>user{0}</b> <p>I, for one, think that this is remark {0} of some length, and it goes on and on, really.</p></div>'
ARTICLE = "<h1>Title</h1>" + "".join(f"<p>{PROSE.format(i)}</p>" for i in range(4))
WHOLE = " ".join(["Title", *(PROSE.format(i) for i in range(4))])


@pytest.mark.parametrize("name", "discussion reader-opinions user-comments-list js-comments-area story-comment-thread responses talkback".split())
@pytest.mark.parametrize("count", [3, 8, 30])
def test_reader_comments_go_inside_and_beside_the_article(name, count):
    row = "".join(COMMENT.format(i) for i in range(count))
    box, items = f'<section class="{name}"><h2>Say something</h2>{row}</section>', "".join(f"<li>{COMMENT.format(i)}</li>" for i in range(count))
    for page in (f"<article>{ARTICLE}</article>{box}", f"<article>{ARTICLE}{box}</article>", f'<main>{ARTICLE}</main><div id="{name}"><ul>{items}</ul></div>', f'<div class="x">{ARTICLE}</div><div class="{name}"><ul>{items}</ul></div>'):
        assert html_text.main_text(f"<html><body>{page}</body></html>") == WHOLE, page[:80]


@pytest.mark.parametrize("name", "article-ad google-ads ad-placement adsbygoogle native-ad div-gpt-ad-1 dfp-ad-unit sticky-promo-bar site-cookie-policy-bar c-newsletter-form".split())
def test_adverts_and_notices_go_inside_and_beside_the_article(name):
    box = f'<div class="{name}"><p>Buy this now, it is cheap, it is good, and it is yours, for a small price, today only, in all shops.</p></div>'
    for page in (f"<article>{ARTICLE}{box}</article>", f"{box}<article>{ARTICLE}</article>", f'<div class="x">{ARTICLE}</div>{box}'):
        assert html_text.main_text(f"<html><body>{page}</body></html>") == WHOLE


@pytest.mark.parametrize(
    "part",
    [
        '<p class="alert">{0} {1}</p>',
        '<ul class="share"><li>{0}</li><li>{1}</li></ul>',
        '<div class="reply"><p>{0}</p><p>{1}</p></div>',
        '<section class="discussion"><h2>Discussion</h2><p>{0}</p><p>{1}</p></section>',
        '<div class="market-share"><p>{0}</p><p>{1}</p></div>',
        '<div class="has-sidebar"><p>{0}</p><p>{1}</p></div>',
    ],
)
def test_parts_of_the_article_stay_whatever_their_names(part):
    text = html_text.main_text(f"<html><body><article>{ARTICLE}{part.format(PROSE.format(7), PROSE.format(8))}</article></body></html>")
    assert PROSE.format(7) in text and PROSE.format(8) in text


@pytest.mark.parametrize("part", ['<p class="alert">Log in to read on</p>', '<ul class="share"><li><a href="x">Post it</a></li><li><a href="y">Send it</a></li></ul>', '<div class="search">find things</div>'])
def test_short_and_linked_parts_go_by_their_names(part):
    assert html_text.main_text(f"<html><body><article>{ARTICLE}{part}</article></body></html>") == WHOLE
