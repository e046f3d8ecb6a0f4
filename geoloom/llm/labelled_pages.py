"""Labelled pages, from which the page model's potentials are trained, made by a rule from parts that pages are made of.

The tables hold no labelled pages. Each page here has an article, in one of the containers that sites use, and around
and inside it menus, headers, footers, sidebars, notices, adverts, forms and reader comments; ``data-content`` marks what
is content. Words are drawn at random, as the model sees only their number. Seeds make other pages, for tests as well.
"""

from __future__ import annotations

import random

#: So many pages, made from so many a seed, train the model of the query.
PAGES, SEED = 900, 1

# What pages call their parts: a tag, and names of which one is its class or id ("" for none).
ARTICLE = [("article", ""), ("article", ""), ("article", "|post|entry|story|h-entry|article"), ("main", "|content|main"), ("div", "content|main-content|article|article-body|post|post-content|entry-content|story-body|text|page-content|body-text|blog-post"), ("section", "content|story|article|post"), ("td", "content|main|"), ("body", "")]
MENU = [("nav", "|main-nav|navbar|navigation|breadcrumb|menu"), ("div", "menu|navbar|nav|navigation|main-menu|topbar|breadcrumbs|pagination|pager|skip-links|toc"), ("ul", "menu|nav|navigation|tabs|breadcrumbs|nav-links|links"), ("menu", "")]
HEADER = [("header", "|site-header|page-header|masthead"), ("div", "header|site-header|masthead|logo|branding|banner|top|tagline")]
FOOTER = [("footer", "|site-footer|page-footer"), ("div", "footer|site-footer|colophon|copyright|bottom|legal|imprint|credits")]
SIDEBAR = [("aside", "|sidebar|related|widget|rail"), ("div", "sidebar|side|right-column|left-column|rail|widget|related|recommended|popular|trending|most-read|more-stories|widget-area|see-also|latest")]
NOTICE = [("div", "notice|cookie-notice|cookie-banner|consent|gdpr|alert|message|warning|disclaimer|popup|modal|overlay|paywall|newsletter|subscribe|cookies|privacy-notice|announcement|toast"), ("section", "notice|newsletter|cookies|subscribe|alert"), ("p", "notice|alert|disclaimer|cookie-notice"), ("dialog", "|consent"), ("aside", "notice|cookie|alert")]
ADVERT = [("div", "ad|ads|advert|advertisement|ad-slot|ad-banner|adbox|sponsored|sponsor|promo|promotion|commercial|banner-ad|adsense|partner|teaser-ad|billboard"), ("aside", "ad|advert|promo|sponsored"), ("p", "ad|advert|sponsored|promo"), ("ins", "adsbygoogle|ad"), ("section", "advert|ads|promo|sponsored"), ("span", "ad|advert|sponsored")]
FORM = [("form", "|search|login|contact|signup|comment-form|subscribe-form|search-form"), ("div", "search|login|signup|search-box|form|contact-form"), ("fieldset", "|search")]
COMMENTS = [("section", "comments|comment-section|responses|discussion|reviews|reader-comments"), ("div", "comments|comment-list|disqus_thread|replies|discussion|responses|user-comments|comments-area|feedback|guestbook|reactions"), ("ol", "commentlist|comments|comment-list"), ("ul", "comments|replies|comment-list")]
SHARE = [("div", "share|social|share-buttons|tags|post-meta|related-links|tools|social-links"), ("ul", "share|social|tags|social-links")]


class Maker:
    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choice("bdfglmnprstvz") + self.rng.choice("aeiou") for _ in range(self.rng.randint(1, 4)))

    def words(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(least, most)))

    def prose(self, least: int = 4, most: int = 60) -> str:
        """A paragraph's text: mostly sentences, at times with links and marked words."""
        out = self.words(least, max(least, int(most ** self.rng.uniform(0.3, 1)))).capitalize()
        if self.rng.random() < 0.15:
            at = out.split(" ")
            i = self.rng.randrange(len(at))
            at[i] = self.rng.choice(['<a href="/x">{}</a>', "<em>{}</em>", '<span class="term">{}</span>', '<span class="highlight">{}</span>', "<b>{}</b>"]).format(at[i])
            out = " ".join(at)
        return out + self.rng.choice([".", ".", ".", ".", "!", "?", "", " $$$"])

    def links(self, least: int = 2, most: int = 9) -> str:
        each = [f'<a href="/{self.word()}">{self.words(1, self.rng.choice([2, 3, 8]))}</a>' for _ in range(self.rng.randint(least, most))]
        shape = self.rng.choice(["<ul>{}</ul>", "{}", "<p>{}</p>", "<ol>{}</ol>"])
        return shape.format("".join(f"<li>{x}</li>" if "l>" in shape else self.rng.choice(["{} ", "{} | "]).format(x) for x in each))

    def part(self, kinds: list[tuple[str, str]], inner: str, content: int) -> str:
        tag, names = self.rng.choice(kinds)
        name = self.rng.choice(names.split("|"))
        written = self.rng.choice([f' class="{name}"', f' class="{name}"', f' id="{name}"', f' class="{self.word()} {name}"', f' id="{self.word()}" class="{name}"']) if name else ""
        if tag in ("ul", "ol", "menu") and "<li" not in inner:
            inner = f"<li>{inner}</li>"
        return f'<{tag}{written} data-content="{content}">{inner}</{tag}>'

    def some(self, share: float, make) -> str:
        return make() if self.rng.random() < share else ""

    def title(self, most: int) -> str:
        tag = self.rng.choice(["h2", "h2", "h3", "h3", "h4", "h5", "p", "div", "b"])
        return f"<{tag}>{self.words(1, most)}</{tag}>"

    def menu(self) -> str:
        return self.part(MENU, self.links(), 0)

    def header(self) -> str:
        return self.part(HEADER, self.rng.choice([f"<h1>{self.words(1, 5)}</h1>", f"<p>{self.words(2, 12)}</p>", f'<a href="/">{self.words(1, 3)}</a>', self.words(1, 6)]) + self.some(0.4, self.menu), 0)

    def footer(self) -> str:
        return self.part(FOOTER, self.rng.choice([f"&copy; {self.words(1, 4)} &middot; {self.prose(3, 20)}", f"<p>{self.words(3, 25)}.</p>", self.links(), self.links() + f"<p>&copy; {self.words(2, 8)}</p>"]), 0)

    def sidebar(self) -> str:
        teaser = lambda: f"<article><h3>{self.words(2, 8)}</h3><p>{self.prose(4, 25)}</p></article>"
        return self.part(SIDEBAR, self.some(0.6, lambda: self.title(4)) + self.rng.choice([self.links(), f"<p>{self.prose()}</p>", teaser() + self.some(0.5, teaser), self.links() + f"<p>{self.prose()}</p>"]), 0)

    def notice(self) -> str:
        inner = self.prose(3, 40)
        return self.part(NOTICE, self.rng.choice([inner, f"<p>{inner}</p>", f"<p>{inner}</p><button>{self.words(1, 2)}</button>"]), 0)

    def advert(self) -> str:
        inner = self.prose(2, 30)
        return self.part(ADVERT, self.rng.choice([inner, inner, f'<a href="/ad">{inner}</a>', f"<p>{inner}</p>", f'{self.title(4)}<p>{inner}</p><a href="/buy">{self.words(1, 3)}</a>']), 0)

    def form(self) -> str:
        return self.part(FORM, f"<label>{self.words(1, 4)}</label><input><p>{self.prose(2, 20)}</p><textarea>{self.words(1, 5)}</textarea><button>{self.words(1, 2)}</button>"[self.rng.choice([0, 0, 12]) :], 0)

    def comment(self) -> str:
        said = f'<p>{self.prose(2, 60)}</p>'
        who = self.rng.choice([f"<b>{self.word()}</b>", f'<span class="author">{self.words(1, 2)}</span>', f"<h4>{self.word()}</h4>", f'<p class="author">{self.word()}</p>', ""])
        return self.rng.choice(['<li class="comment">{}</li>', "<li>{}</li>", '<div class="comment">{}</div>', "<div>{}</div>", '<article class="comment">{}</article>', "{}"]).format(who + said)

    def comments(self) -> str:
        return self.part(COMMENTS, self.some(0.6, lambda: self.title(3)) + "".join(self.comment() for _ in range(self.rng.randint(1, 8))) + self.some(0.3, self.form), 0)

    def share(self) -> str:
        return self.part(SHARE, self.links(2, 5), 0)

    def block(self) -> str:
        rng = self.rng
        if rng.random() < 0.72:
            open_p = rng.choice(["<p>", "<p>", "<p>", "<p>", '<p class="lead">', "<p><b>", "<div>"])
            return open_p + self.prose(1, 120) + rng.choice(["</p>", "</p>", "</p>", "<br>", ""] if open_p != "<div>" else ["</div>"])
        return rng.choice([
            lambda: f"<h2>{self.words(1, 9)}</h2>", lambda: f"<h3>{self.words(1, 9)}</h3>", lambda: "<ul>" + "".join(f"<li>{self.prose(1, 25)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>",
            lambda: "<ol>" + "".join(f"<li>{self.prose(1, 25)}</li>" for _ in range(rng.randint(2, 6))) + "</ol>", lambda: f"<blockquote>{rng.choice(['<p>{}</p>', '{}']).format(self.prose())}</blockquote>",
            lambda: f"<pre>{self.words(3, 30)}</pre>", lambda: "<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>",
            lambda: f'<figure><img src="x"><figcaption>{self.prose(3, 15)}</figcaption></figure>', lambda: f"<section><h2>{self.words(1, 6)}</h2><p>{self.prose()}</p><p>{self.prose()}</p></section>",
            lambda: f"<div><p>{self.prose()}</p><p>{self.prose()}</p></div>", lambda: self.prose(5, 60), lambda: f"<dl><dt>{self.words(1, 3)}</dt><dd>{self.prose(3, 20)}</dd></dl>", lambda: f'<div class="caption">{self.prose(3, 20)}</div>',
        ])()

    def article(self) -> tuple[str, bool]:
        """The article with what stands inside it, and whether it is the page's whole body."""
        rng = self.rng
        tiny = rng.random() < 0.15
        blocks = [f"<p>{self.words(1, 6)}{rng.choice(['.', ''])}</p>"] if tiny else [self.block() for _ in range(int(30 ** rng.random()))]
        for make, share in ((self.advert, 0.3), (self.notice, 0.12), (self.sidebar, 0.12), (self.share, 0.2), (self.form, 0.08), (self.menu, 0.05)):
            if rng.random() < share:
                blocks.insert(rng.randint(0, len(blocks)), make())
        if rng.random() < 0.7:
            blocks.insert(0, f"<h1>{self.words(1, 10)}</h1>")
        inner = "\n".join(blocks) + self.some(0.1, self.comments) + self.some(0.05, self.footer)
        out = self.part(ARTICLE, inner, 1)
        if out.startswith("<td"):
            out = "<table><tr>" + self.some(0.5, lambda: f'<td data-content="0">{self.links()}</td>') + out + "</tr></table>"
        return out, out.startswith("<body")

    def page(self) -> str:
        rng = self.rng
        article, whole = self.article()
        ahead = [make for make, share in ((self.header, 0.5), (self.menu, 0.7), (self.notice, 0.25), (self.advert, 0.4), (self.form, 0.2), (self.sidebar, 0.2)) if rng.random() < share]
        after = [make for make, share in ((self.sidebar, 0.35), (self.comments, 0.4), (self.advert, 0.25), (self.notice, 0.2), (self.form, 0.15), (self.menu, 0.15), (self.footer, 0.75), (self.share, 0.1)) if rng.random() < share]
        alone = rng.random() < 0.1
        head, tail = ("", "") if alone else ("\n".join(m() for m in ahead), "\n".join(m() for m in after))
        if whole:
            start, rest = article.split(">", 1)
            return f"<html><head><title>x</title></head>{start}>{head}{rest[: -len('</body>')]}{tail}</body></html>"
        for tag in rng.choice([[], [], ["div"], ["div", "div"], ["main"], ["section"]]):
            article = f"<{tag}{rng.choice(['', ' class=wrapper', ' id=page', ' class=container'])}>{article}{self.some(0.2, self.sidebar)}</{tag}>" if tag != "main" or "<main" not in article else article
        body = f"{head}{article}{tail}"
        for _ in range(rng.choice([0, 0, 1, 2])):
            body = f"<div{rng.choice(['', ' id=page', ' class=wrapper', ' class=container', ' id=root'])}>{body}</div>"
        return body if rng.random() < 0.15 else f"<html><head><title>x</title></head><body>{body}</body></html>"


def pages(count: int = PAGES, seed: int = SEED) -> list[str]:
    """``count`` labelled pages."""
    maker = Maker(seed)
    return [maker.page() for _ in range(count)]
