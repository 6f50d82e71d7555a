"""Generated web pages in which each piece of text is known to be article or not: what `html_text` learns from.

A lesson is one page, made of its number alone: a layout, names (telling ones, unhelpful ones, none), an article and what
commonly stands around and inside one. Text of the article carries MARK. Words are invented, so nothing of a language is learned.
"""

from __future__ import annotations

import random

MARK = "\ue000"

# Names that sites commonly give to parts of a page (fixed values).
ARTICLE_NAMES = "content main-content article article-body post post-content entry entry-content story story-body page-content text body-text blog-post main primary single post-body articleText newsBody prose".split()
SHELL_NAMES = "page wrapper container site layout outer row inner app root grid columns wrap page-wrap main-wrapper".split()
NAV_NAMES = "nav menu navbar main-nav navigation topnav breadcrumb breadcrumbs site-nav pagination pager tabs skip-links nav-links submenu toc".split()
HEADER_NAMES = "header site-header masthead top-bar branding logo banner page-header".split()
FOOTER_NAMES = "footer site-footer bottom copyright legal colophon footer-links credits".split()
SIDE_NAMES = "sidebar side aside widget widget-area related related-posts recommended popular trending more-stories secondary rail author-box tags promo-list".split()
AD_NAMES = "ad ads advert advertisement adsbygoogle ad-slot sponsor sponsored banner-ad promo promotion adbox dfp".split()
NOTICE_NAMES = "notice cookie cookie-banner cookie-notice consent gdpr alert popup modal newsletter subscribe paywall disclaimer message toast overlay".split()
COMMENT_NAMES = "comments comment comment-list commentlist discussion disqus replies respond reader-comments feedback responses reactions user-comments".split()
SHARE_NAMES = "share social sharing share-buttons social-links share-bar follow byline-share".split()
FORM_NAMES = "search search-form login newsletter-form signup contact-form comment-form subscribe-form".split()
PLAIN_NAMES = "box block module section item unit col left right panel card group area c1 x9 b2 css-1a2b jss12 u-mt".split()
WORDS = [a + b for a in "ba de ki lo mu ra se ti vo na pe shu gri".split() for b in ("", "n", "r", "st", "lo", "ming", "tion", "é", "ß", "ka")]
NOISE = ("***", "###", "%%%", "$$$", "&amp;&amp;&amp;", "|")


class Lesson:
    def __init__(self, number: int):
        self.rnd = random.Random(number)
        r = self.rnd
        self.telling = r.choice([0.0, 0.4, 0.8, 0.95])  # how often a name tells what a part is
        self.semantic = r.choice([0.0, 0.5, 1.0])  # how often HTML5's own elements are used
        self.sloppy = r.random() < 0.4  # leaves paragraphs open
        self.noise = r.random() < 0.2
        self.style = r.choice(["", "", "", "", "bare", "repeated", "listed", "numbers"])  # odd ways of writing, in articles alone

    def words(self, least: int, most: int) -> str:
        r, out = self.rnd, []
        n = int(round(least * (most / least) ** r.random()))
        left = 0
        for k in range(n):
            word = r.choice(WORDS)
            if not left:
                word, left = word.capitalize(), r.randint(3, 16)
            left -= 1
            if not left or k == n - 1:
                word += r.choice("...!?")
            elif r.random() < 0.08:
                word += ","
            if self.noise and r.random() < 0.6:
                word += r.choice(NOISE)
            out.append(word)
        return " ".join(out)

    def prose(self, least: int, most: int) -> str:
        """Text of an article; some write without marks, repeat words, or part them by bars or numbers."""
        r, text = self.rnd, self.words(least, most)
        if not self.style or r.random() < 0.4:
            return text
        words = [w.strip(".,!?") for w in text.split(" ")]
        if self.style == "repeated":
            words = [w for w in words for _ in range(r.choice([1, 5, 20]))][: len(words) + 5]
        elif self.style == "listed":
            return " | ".join(words)
        elif self.style == "numbers":
            words = [str(r.randint(0, 99_999)) if r.random() < 0.5 else w for w in words]
        return " ".join(words)

    def heading(self, most: int) -> str:
        """Some end without a mark, or were cut off."""
        text = self.words(1, most)
        kind = self.rnd.random()
        return text.rstrip(".!?") if kind < 0.4 else text[: self.rnd.randint(20, 70)].strip() if kind < 0.6 else self.short() if kind < 0.75 else text

    def short(self, most: int = 3) -> str:
        return " ".join(self.rnd.choice(WORDS).capitalize() for _ in range(self.rnd.randint(1, most)))

    def name(self, names: list[str], tell: float | None = None) -> str:
        """Attributes of a part."""
        r = self.rnd
        if r.random() < (self.telling if tell is None else tell):
            chosen = r.choice(names)
            chosen = chosen if r.random() < 0.7 else f"{r.choice(['js', 'm', 'block', 'site', 'c'])}-{chosen}"
            if r.random() < 0.3:
                chosen += f"-{r.randint(1, 99)}" if r.random() < 0.5 else f" {r.choice(PLAIN_NAMES)}"
        elif r.random() < 0.5:
            chosen = r.choice(PLAIN_NAMES)
        else:
            return ""
        return f' {r.choice(["class", "class", "class", "id"])}="{chosen}"'

    def part(self, own: str, names: list[str], inner: str, certain: bool = False) -> str:
        """A part of the page as HTML's own element, or as a named block. One that nothing but its name sets apart is named."""
        if own and self.rnd.random() < self.semantic:
            return f"<{own}{self.name(names, self.telling / 2)}>{inner}</{own}>"
        tag = self.rnd.choice(["div", "div", "section"])
        return f"<{tag}{self.name(names, 1.0 if certain else None)}>{inner}</{tag}>"

    def link(self, text: str | None = None) -> str:
        return f'<a href="/{self.rnd.choice(WORDS)}">{text or self.short()}</a>'

    def links(self, most: int = 9) -> str:
        r, n = self.rnd, self.rnd.randint(2, most)
        style = r.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"
        return r.choice([" | ", " ", " &middot; "]).join(self.link() for _ in range(n))

    def inline(self, text: str) -> str:
        """Some words as links or emphasis."""
        r, words = self.rnd, text.split(" ")
        if len(words) > 6 and r.random() < 0.35:
            k = r.randrange(len(words) - 3)
            piece = " ".join(words[k : k + 3])
            tag = r.choice(["a href='/x'", "b", "em", "strong", "span class='hl'"])
            words[k : k + 3] = [f"<{tag}>{piece}</{tag.split()[0]}>"]
        return " ".join(words)

    def paragraph(self, text: str) -> str:
        r = self.rnd
        if self.sloppy and r.random() < 0.35:
            return r.choice([f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text}<br>"])
        return f"<p>{self.inline(text)}</p>"

    def article(self) -> str:
        r, out = self.rnd, []
        if r.random() < 0.85:
            head = f"<h1>{MARK}{self.heading(16)}</h1>"
            out.append(f"<header>{head}</header>" if r.random() < 0.12 else head)
        n = r.choice([1, 1, 2, 4, 8, 16, 30])
        size = r.choice([4, 20, 60, 120])
        long = r.randrange(n) if r.random() < 0.35 else -1
        for k in range(n):
            kind = r.random()
            if k == long:
                out.append(self.paragraph(MARK + self.prose(150, 4_000)))
                continue
            if kind < 0.78 or n == 1:
                out.append(self.paragraph(MARK + self.prose(1, size)))
            elif kind < 0.84:
                out.append(f"<h2>{MARK}{self.heading(12)}</h2>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.prose(2, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote><p>{MARK}{self.prose(5, 40)}</p></blockquote>")
            elif kind < 0.94:
                out.append(f"<figure><img src=x.png><figcaption>{MARK}{self.prose(3, 15)}</figcaption></figure>")
            elif kind < 0.96:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{self.prose(1, 3)}<td>{MARK}{self.prose(1, 3)}" for _ in range(3)) + "</table>")
            elif kind < 0.98:
                out.append(f"<pre>{MARK}{self.prose(3, 20)}</pre>")
            else:
                out.append(f"<div>{MARK}{self.prose(5, 40)}</div>")
            if r.random() < 0.12:
                out.append(self.inserted())
        if r.random() < 0.15:
            out.append(self.part("", COMMENT_NAMES, self.comments(), True))
        if r.random() < 0.12:
            out.append(self.part("footer", FOOTER_NAMES, self.words(2, 12), True))
        return "".join(out)

    def inserted(self) -> str:
        """What stands inside articles without belonging to them."""
        r = self.rnd
        kind = r.randrange(6)
        if kind == 0:
            return self.part("", AD_NAMES, self.words(3, 30), True)
        if kind == 1:
            return self.part("aside", SIDE_NAMES, f"<h3>{self.short()}</h3>{self.links(6)}", True)
        if kind == 2:
            return self.part("", SHARE_NAMES, self.links(5), True)
        if kind == 3:
            return self.part("", NOTICE_NAMES, f"<p>{self.words(5, 30)}</p>", True)
        if kind == 4:
            return self.form()
        return f'<p{self.name(AD_NAMES + NOTICE_NAMES, 1.0)}>{self.words(3, 25)}</p>'

    def form(self) -> str:
        r = self.rnd
        text = self.words(2, 25) if r.random() < 0.6 else ""
        fields = "".join(f"<label>{self.short()}</label><input type=text>" for _ in range(r.randint(1, 3)))
        return f"<form{self.name(FORM_NAMES)}>{f'<p>{text}</p>' if text and r.random() < 0.6 else text}{fields}<button>{self.short()}</button></form>"

    def comments(self) -> str:
        r, out = self.rnd, []
        if r.random() < 0.7:
            out.append(f"<h3>{self.short()}</h3>")
        for _ in range(r.choice([1, 2, 4, 9])):
            body = f"{r.choice([f'<b>{self.short(2)}</b>', self.link(), f'<span class=author>{self.short()}</span>', ''])}<p>{self.words(2, 90)}</p>"
            out.append(r.choice([f"<div{self.name(['comment', 'reply'])}>{body}</div>", f"<li{self.name(['comment'])}>{body}</li>", f"<article{self.name(['comment'], 1.0)}>{body}</article>"]))
        if r.random() < 0.3:
            out.append(self.form())
        return "".join(out)

    def around(self, kind: str) -> str:
        r = self.rnd
        if kind == "header":
            return self.part("header", HEADER_NAMES, r.choice([f"<h1>{self.link()}</h1>", f"<p>{self.words(2, 10)}</p>", self.link(), self.short()]) + (self.links() if r.random() < 0.4 else ""))
        if kind == "nav":
            return self.part("nav", NAV_NAMES, self.links(14))
        if kind == "ad":
            return self.part("", AD_NAMES, r.choice([self.words(2, 30), f"<p>{self.words(2, 30)}</p>", self.link(self.words(2, 12))]), True)
        if kind == "notice":
            return self.part("", NOTICE_NAMES, f"{r.choice([f'<p>{self.words(4, 40)}</p>', self.words(4, 40)])}{r.choice(['', '<button>Ok</button>', self.link()])}", True)
        if kind == "side":
            body = r.choice([self.links(), f"<h3>{self.short()}</h3>{self.links()}", f"<h3>{self.short()}</h3><p>{self.words(3, 60)}</p>", "".join(f"<div><h4>{self.link(self.words(3, 9))}</h4><p>{self.words(4, 25)}</p></div>" for _ in range(r.randint(1, 5)))])
            return self.part("aside", SIDE_NAMES, body, True)
        if kind == "form":
            return self.form()
        if kind == "comments":
            return self.part("", COMMENT_NAMES, self.comments(), True)
        if kind == "share":
            return self.part("", SHARE_NAMES, self.links(5))
        body = r.choice([f"&copy; {r.choice(WORDS)}.example.com &middot; {self.words(2, 14)}", f"<p>{self.words(2, 25)}</p>", self.links(), f"<p>&copy; {self.short()}</p>{self.links()}"])
        return self.part("footer", FOOTER_NAMES, body)

    def page(self) -> str:
        r = self.rnd
        before = [k for k, p in (("notice", 0.2), ("header", 0.5), ("nav", 0.8), ("form", 0.15), ("ad", 0.5), ("side", 0.15), ("share", 0.1)) if r.random() < p]
        after = [k for k, p in (("share", 0.2), ("ad", 0.25), ("comments", 0.35), ("side", 0.4), ("form", 0.15), ("nav", 0.1), ("footer", 0.85), ("notice", 0.15)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        main = ""
        if r.random() < 0.95:
            # without a telling name or element a one-line article can't be told from other lines, so those have one
            own = r.choice(["article", "article", "main"])
            main = self.article()
            main = f"<{own}{self.name(ARTICLE_NAMES, 0.3)}>{main}</{own}>" if r.random() < max(0.35, self.semantic) else f"<div{self.name(ARTICLE_NAMES, 1.0 if len(main) < 900 else None)}>{main}</div>"
        near = [k for k in before if k in ("share", "ad", "side") and r.random() < 0.4]
        close = [k for k in after if k in ("share", "ad", "side", "comments") and r.random() < 0.5]
        if near or close or r.random() < 0.3:
            inner = "".join(map(self.around, near)) + main + "".join(map(self.around, close))
            main = self.part("main", SHELL_NAMES + ["main", "content"], inner)
        body = "".join(self.around(k) for k in before if k not in near) + main + "".join(self.around(k) for k in after if k not in close)
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f"<div{self.name(SHELL_NAMES)}>{body}</div>"
        gap = r.choice(["", "\n", "\n  "])
        return f"<!DOCTYPE html><html><head><title>{self.short()}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{body.replace('><', f'>{gap}<')}<!-- {self.short()} --></body></html>"


def lesson(number: int) -> str:
    return Lesson(number).page()
