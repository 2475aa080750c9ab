"""Web pages put together by seed, for the extraction's trees to learn from.

A page is a layout (menus, headers, footers, sidebars, notices, adverts, forms,
comments around and within an article) in which every element's tag, attributes,
nesting and order are drawn, so that no single sign tells the article: some pages use
telling elements, some telling attributes, some neither. The wording comes from pieces
of the corpus. Main texts begin with ``MARK``.
"""

from __future__ import annotations

import html
import random

MARK = ""
#: Attribute tokens of the parts, of which a page draws one each.
NAMES = {
    "article": ["article", "post", "entry-content", "content", "main-content", "story-body", "articleBody", "post-body", "text", "mw-body", "page-content"],
    "menu": ["nav", "menu", "main-menu", "navbar", "top-nav", "breadcrumbs", "navigation", "tabs"],
    "header": ["header", "site-header", "masthead", "top-bar", "branding"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal"],
    "side": ["sidebar", "aside", "widget", "rail", "related", "right-column", "recommended", "popular-posts", "teasers"],
    "notice": ["cookie-notice", "consent", "gdpr-banner", "alert", "notice", "privacy-popup", "modal"],
    "advert": ["ad", "ads", "advert", "sponsored", "ad-slot", "promo", "commercial"],
    "form": ["newsletter", "search-form", "login", "signup", "subscribe-box", "contact-form"],
    "comments": ["comments", "comment-list", "disqus_thread", "responses", "discussion", "replies"],
    "share": ["share", "social-links", "follow-us"],
}
TAGS = {"article": ["article", "main", "section", "div"], "menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "side": ["aside", "div", "section"], "notice": ["div", "section", "dialog"], "advert": ["div", "aside", "section"], "form": ["form", "div"], "comments": ["section", "div", "ol"], "share": ["div", "ul"]}
NEUTRAL = ["row", "col-md-8", "wrapper", "inner", "box", "container", "css-1x9k", "grid", "sc-a8f2", "clearfix", "block-3", "u-mt-2"]
STATED = {
    "notice": ["We use cookies to improve this site.", "Wir verwenden Cookies.", "Ce site utilise des cookies.", "Usamos cookies propias y de terceros.", "Please read our updated privacy terms."],
    "advert": ["Advertisement", "Sponsored", "Anzeige", "Publicité", "Publicidad", ""],
    "form": ["Subscribe to our newsletter", "Log in", "Search", "Newsletter abonnieren", "Votre adresse", "Suscríbete"],
    "comments": ["Comments", "3 comments", "12 Kommentare", "Commentaires", "Comentarios", "Leave a reply", "Discussion"],
    "footer": ["&copy; 2024 ", "© ", "All rights reserved. ", "Impressum ", "Copyright 2020 ", "Powered by ", ""],
}


class Maker:
    def __init__(self, seed: int, pieces: list[str]):
        self.r = random.Random(seed)
        self.pieces = pieces
        #: how telling the page's elements and attributes are
        self.by_tag, self.by_name = self.r.choice([(1.0, 1.0), (0.9, 0.3), (0.2, 0.9), (0.0, 0.9), (0.5, 0.5), (0.0, 0.15), (1.0, 0.0)])
        self.close_p = self.r.random() < 0.85

    def words(self, low: int, high: int) -> str:
        found, n = [], self.r.randint(low, high)
        while len(found) < n:
            part = self.r.choice(self.pieces).split()
            start = self.r.randrange(len(part))
            found += part[start : start + n - len(found)]
        return html.escape(" ".join(found), quote=False)

    def sentences(self, low: int, high: int) -> str:
        text = self.words(low, high)
        return text if text[-1] in ".!?" or self.r.random() < 0.15 else text + self.r.choice("...!?")

    def part(self, kind: str, inner: str, level: int = 0) -> str:
        """An element of a kind, in up to three neutral ones."""
        r = self.r
        tag = r.choice(TAGS[kind]) if r.random() > self.by_tag else TAGS[kind][0]
        if r.random() > self.by_tag and tag not in ("ul", "ol"):
            tag = "div"
        names = [r.choice(NAMES[kind])] if r.random() < self.by_name else [r.choice(NEUTRAL)] if r.random() < 0.5 else []
        if names and r.random() < 0.4:
            names.append(r.choice(NEUTRAL))
        r.shuffle(names)
        at = f' {r.choice(["class", "class", "id"])}="{" ".join(names)}"' if names else ""
        out = f"<{tag}{at}>{inner}</{tag}>"
        for _ in range(r.choice([0, 0, 1, 1, 2]) if level == 0 else 0):
            out = f'<div{r.choice(["", "", f" class={chr(34)}{r.choice(NEUTRAL)}{chr(34)}"])}>{out}</div>'
        return out

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.r.randrange(999)}">{self.words(low, high)}</a>'

    def menu(self, low: int = 3, high: int = 9) -> str:
        n, form = self.r.randint(low, high), self.r.random()
        if form < 0.6:
            return self.part("menu", "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>")
        return self.part("menu", self.r.choice([" | ", " ", "<br>", " &middot; "]).join(self.link() for _ in range(n)))

    def header(self) -> str:
        name = self.words(1, 4)
        inner = self.r.choice([f"<h1>{name}</h1>", f'<a href="/">{name}</a>', f"<h2>{name}</h2><p>{self.words(2, 8)}</p>", f'<div class="logo">{name}</div>'])
        return self.part("header", inner + (self.menu() if self.r.random() < 0.5 else ""))

    def footer(self) -> str:
        text = self.r.choice(STATED["footer"]) + self.words(1, 14)
        return self.part("footer", self.r.choice(["", "<p>"]) + text + (self.menu(2, 6) if self.r.random() < 0.4 else ""))

    def advert(self) -> str:
        said = self.r.choice(STATED["advert"])
        return self.part("advert", (f"<span>{said}</span>" if said else "") + self.r.choice([self.words(2, 20), f"<p>{self.sentences(3, 20)}</p>", f'<a href="http://x"><img src="a.png">{self.words(2, 8)}</a>']), 1)

    def notice(self) -> str:
        return self.part("notice", f"<p>{self.r.choice(STATED['notice'])} {self.words(0, 16) if self.r.random() < 0.6 else ''}</p>" + self.r.choice(["", "<button>OK</button>", f"<button>{self.words(1, 2)}</button>{self.link()}"]))

    def form(self) -> str:
        fields = "".join(f'<label>{self.words(1, 3)}</label><input name="f{i}">' for i in range(self.r.randint(1, 4)))
        return self.part("form", f"{self.r.choice(['', '<h3>', '<p>'])}{self.r.choice(STATED['form'])} {fields}<button>{self.words(1, 2)}</button>")

    def side(self) -> str:
        form = self.r.random()
        if form < 0.5:
            inner = f"<h3>{self.words(1, 4)}</h3><ul>" + "".join(f"<li>{self.link(2, 9)}</li>" for _ in range(self.r.randint(2, 8))) + "</ul>"
        elif form < 0.8:
            inner = "".join(f'<div><img src="i.png"><h4>{self.link(2, 8)}</h4><p>{self.words(5, 25)}</p></div>' for _ in range(self.r.randint(1, 4)))
        else:
            inner = f"<h3>{self.words(1, 3)}</h3><p>{self.sentences(4, 30)}</p>"
        return self.part("side", inner)

    def comments(self) -> str:
        r, rows = self.r, []
        item = r.choice(["li", "li", "div", "div", "p", "article"] if r.random() < 0.4 else ["li", "div"])
        for _ in range(r.randint(1, 6)):
            who = r.choice([f"<b>{self.words(1, 2)}</b>", f"<span class={chr(34)}author{chr(34)}>{self.words(1, 2)}</span> 12:{r.randint(10, 59)}", f"<cite>{self.words(1, 2)}</cite> says:"])
            name = f' class="{r.choice(["comment", "reply", "response-item"])}"' if r.random() < self.by_name else ""
            rows.append(f"<{item}{name}>{who} " + (f"<p>{self.sentences(4, 50)}</p>" if item != "p" and r.random() < 0.7 else self.sentences(4, 50)) + f"</{item}>")
        title = r.choice([f"<h3>{r.choice(STATED['comments'])}</h3>", f"<h3>{r.choice(STATED['comments'])}</h3>", f"<h2>{self.words(1, 5)}</h2>", ""])
        inner = title + ("<ol>" + "".join(rows) + "</ol>" if item == "li" else "".join(rows))
        return self.part("comments", inner + (self.form() if r.random() < 0.3 else ""))

    def paragraph(self, text: str) -> str:
        return f"<p>{text}</p>" if self.close_p else f"<p>{text}\n"

    def body(self) -> list[str]:
        """The article's blocks."""
        r = self.r
        n = r.choice([1, 1, 2, 3, 4, 6, 9, 14])
        out = []
        for _ in range(n):
            form, size = r.random(), r.choice([(1, 5), (5, 20), (15, 50), (30, 90)])
            text = MARK + self.sentences(*size)
            if r.random() < 0.06:  # an article may say what a notice says
                text = f"{text} {r.choice([x for k in STATED.values() for x in k])} {self.words(1, 12)}"
            if form < 0.07:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.words(2, 15)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif form < 0.12:
                out.append(f"<h2>{MARK}{self.words(1, 7)}</h2>" + self.paragraph(text))
            elif form < 0.16:
                out.append(f"<blockquote>{self.paragraph(text)}</blockquote>")
            elif form < 0.19:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{self.words(1, 3)}</td><td>{MARK}{self.words(1, 8)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif form < 0.22:
                out.append(f'<figure><img src="p.png"><figcaption>{MARK}{self.words(3, 12)}</figcaption></figure>')
            elif form < 0.32:
                out.append(self.paragraph(text + f" {self.link()} " + self.sentences(3, 20)))
            elif form < 0.40:
                out.append(f"<p><b>{text}<br>")
            else:
                out.append(self.paragraph(text))
        return out

    def article(self) -> str:
        r = self.r
        if r.random() < 0.12:  # lines of one element
            inner = MARK + "<br><br>".join(self.sentences(8, 60) for _ in range(r.randint(1, 6)))
            parts = [f"<div>{inner}</div>"]
        else:
            parts = self.body()
        for kind, odds in ((self.advert, 0.3), (self.form, 0.1), (self.side, 0.12)):
            if r.random() < odds:
                parts.insert(r.randint(0, len(parts)), kind())
        if r.random() < 0.7:
            title = f"<{(t := r.choice(['h1', 'h1', 'h2']))}>{MARK}{self.words(1, 12)}</{t}>"
            parts.insert(0, title)
        if r.random() < 0.25:
            parts.insert(r.choice([1, len(parts)]), self.part("share", "".join(f"<li>{self.link(1, 1)}</li>" for _ in range(r.randint(2, 5))), 1))
        if r.random() < 0.2:
            parts.append(self.comments())
        return self.part("article", "".join(parts))


def page(seed: int, pieces: list[str]) -> str:
    """One page; the same for the same seed and pieces."""
    m = Maker(seed, pieces)
    r = m.r
    if r.random() < 0.03:
        return f"<p>{MARK}{m.sentences(3, 60)}</p>" if r.random() < 0.5 else MARK + m.sentences(3, 60)
    before = [f() for f, odds in ((m.notice, 0.25), (m.header, 0.6), (m.menu, 0.7), (m.advert, 0.4), (m.side, 0.25), (m.form, 0.15)) if r.random() < odds]
    after = [f() for f, odds in ((m.side, 0.4), (m.comments, 0.4), (m.advert, 0.2), (m.form, 0.2), (m.menu, 0.15), (m.notice, 0.15), (m.footer, 0.75)) if r.random() < odds]
    if r.random() < 0.3:
        r.shuffle(before)
    middle = m.article() if r.random() < 0.95 else m.side() + m.menu()
    if r.random() < 0.2:
        middle = f"<table><tr><td>{''.join(before[-1:])}</td><td>{middle}</td></tr></table>"
        before = before[:-1]
    elif r.random() < 0.3:
        middle = f'<div class="{r.choice(NEUTRAL)}">{middle}{"".join(after[:1])}</div>'
        after = after[1:]
    return f"<!DOCTYPE html><html><head><title>{m.words(1, 6)}</title><script>var a='<p>';</script></head><body>{''.join(before)}<!-- {m.words(1, 3)} -->{middle}{''.join(after)}</body></html>"
