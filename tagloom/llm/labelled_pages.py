"""Labelled pages from which the extraction of main text is trained.

``data-main="1"`` marks elements whose text is main text, ``data-main="0"`` parts inside them that are not.  The pages are composed by
rule: each draws a layout, the names of its parts and invented words.  Their number and seed are the parameters.
"""

from __future__ import annotations

import random

# What parts of pages are commonly called in class and id.
MENU = "menu nav navbar navigation topnav breadcrumb breadcrumbs toc pagination pager links tabs".split()
HEADER = "header masthead site-header top banner branding topbar".split()
FOOTER = "footer site-footer copyright colophon bottom legal".split()
SIDE = "sidebar side widget related recommended popular trending tags archive teaser more".split()
NOTICE = "notice cookie cookie-banner consent alert gdpr message popup modal paywall warning disclaimer".split()
ADVERT = "ad ads advert advertisement adsense sponsored sponsor promo promotion banner-ad commercial".split()
FORM = "search newsletter subscribe login contact signup form feedback".split()
COMMENTS = "comments comment-list discussion replies responses disqus comment-section reactions".split()
SHARE = "share social sharing follow".split()
CONTENT = "content post entry article story article-body entry-content post-content main text body page single".split()
PLAIN = "wrapper container row col inner box block section grid layout page".split()
SYLLABLES = "an ber co de el fa gu hi in jo ka li mo ne or pa qui re sa tu un va we xe yo zu é è ß ü ñ ção".split()


class _Writer:
    def __init__(self, draw: random.Random):
        self.draw = draw

    def word(self) -> str:
        return "".join(self.draw.choices(SYLLABLES, k=self.draw.randrange(1, 5)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.draw.randint(low, high)))

    def sentence(self) -> str:
        draw = self.draw
        text = self.words(1, 9 if draw.random() < 0.5 else 25).capitalize()
        if draw.random() < 0.3:
            text += ", " + self.words(2, 9)
        if draw.random() < 0.1:
            text = f'<a href="/{self.word()}">{text}</a>' if draw.random() < 0.3 else f"<b>{text}</b>"
        return text + draw.choice("....?!")

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.draw.randint(low, high)))

    def named(self, names: list[str], tags: str, inner: str, mark: str = "") -> str:
        """An element with one of the names, as class or id, or one that says it by its tag alone."""
        draw, tag = self.draw, self.draw.choice(tags.split())
        bare = tag not in ("div", "ul", "ol", "section", "p", "span", "table")
        how = "" if bare and draw.random() < 0.6 else f' {draw.choice(["class", "class", "id"])}="{draw.choice(names)}"'
        return f"<{tag}{how}{mark}>{inner}</{tag}>"

    def plain(self, inner: str) -> str:
        if self.draw.random() < 0.6:
            return inner
        return f'<div class="{self.draw.choice(PLAIN)}">{inner}</div>' if self.draw.random() < 0.7 else f"<div>{inner}</div>"

    def links(self) -> str:
        many = self.draw.randint(2, 12)
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(many)]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.draw.random() < 0.7 else " | ".join(items)

    def menu(self) -> str:
        return self.named(MENU, "nav nav nav div ul", self.links())

    def header(self) -> str:
        inner = self.draw.choice([f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.sentence()}</p>"])
        return self.named(HEADER, "header header div", inner + (self.menu() if self.draw.random() < 0.5 else ""))

    def footer(self) -> str:
        inner = self.draw.choice([f"&copy; {self.word()}.example.org &middot; {self.prose(1, 2)}", f"<p>&copy; 2024 {self.words(2, 5)}</p>",
                                  self.links(), f"<p>{self.prose(1, 3)}</p>{self.links()}"])
        return self.named(FOOTER, "footer footer div", inner)

    def side(self) -> str:
        inner = f"<h3>{self.words(1, 3)}</h3>" + self.draw.choice([self.links(), f"<p>{self.prose(1, 3)}</p>", self.links() + self.advert()])
        return self.named(SIDE, "aside aside div section", inner)

    def notice(self) -> str:
        return self.named(NOTICE, "div div section aside", f"<p>{self.prose(1, 3)}</p>" + self.draw.choice(["", f"<button>{self.words(1, 2)}</button>"]))

    def advert(self) -> str:
        text = self.prose(1, 3)
        return self.named(ADVERT, "div div div section aside", self.draw.choice([text, text, f"<p>{text}</p>", f'<a href="/x">{text}</a>']))

    def form(self) -> str:
        fields = f"<label>{self.words(1, 3)}</label><input name='q'><button>{self.words(1, 2)}</button>"
        inner = self.draw.choice([fields, f"<p>{self.sentence()}</p>{fields}", f"<h4>{self.words(2, 4)}</h4><select><option>{self.word()}</select>{fields}"])
        return self.named(FORM, "form form form div", inner)

    def comments(self) -> str:
        one = lambda: self.draw.choice([
            f'<div class="comment"><b>{self.word()}</b><p>{self.prose(1, 5)}</p></div>', f'<article class="comment"><p>{self.prose(1, 6)}</p></article>',
            f'<li class="comment">{self.prose(1, 4)}</li>', f'<div class="reply"><p>{self.prose(1, 3)}</p><p>{self.prose(1, 3)}</p></div>'])
        inner = f"<h2>{self.words(1, 3)}</h2>" + "".join(one() for _ in range(self.draw.randint(1, 6)))
        return self.named(COMMENTS, "div div section ol", inner + (self.form() if self.draw.random() < 0.3 else ""))

    def share(self) -> str:
        return self.named(SHARE, "div ul", self.links())

    def body(self) -> str:
        """The blocks of an article, unclosed paragraphs among them."""
        draw, out = self.draw, []
        if draw.random() < 0.85:
            title = f"<h1>{self.words(2, 10)}</h1>"
            out.append(f"<header>{title}</header>" if draw.random() < 0.15 else title)
        for _ in range(draw.choice([1, 1, 2, 3, 5, 8, 14])):
            out.append(draw.choices([
                f"<p>{self.prose(1, 8)}</p>", f"<p><b>{self.prose(1, 3)}<br><p>{self.prose(1, 4)}</p>", f"<h2>{self.words(1, 7)}</h2><p>{self.prose(1, 5)}</p>",
                f"<ul>{''.join(f'<li>{self.sentence()}</li>' for _ in range(draw.randint(2, 6)))}</ul>", f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>",
                f"<figure><img src='x.png'><figcaption>{self.sentence()}</figcaption></figure>", f"<div>{self.prose(1, 4)}</div>", f"<p>{self.words(1, 4)}</p>",
                f"<table><tr><th>{self.word()}<th>{self.word()}<tr><td>{self.words(1, 3)}<td>{self.words(1, 3)}</table>", f"<pre>{self.words(3, 20)}</pre>",
            ], weights=[12, 3, 4, 2, 1, 1, 1, 2, 1, 1])[0])
            if draw.random() < 0.12:
                part = draw.choice([self.advert, self.share, self.notice, self.form, self.side, self.menu])()
                out.append(f'<div data-main="0">{part}</div>' if draw.random() < 0.1 else part.replace(">", ' data-main="0">', 1))
        return "".join(out)


def labelled_page(seed: int) -> str:
    """One page, the same for the same seed."""
    draw = random.Random(seed)
    w = _Writer(draw)
    inside = w.body()
    late = [part().replace(">", ' data-main="0">', 1) for part, share in ((w.share, 0.2), (w.comments, 0.25), (w.form, 0.1), (w.footer, 0.1), (w.side, 0.1))
            if draw.random() < share]
    main = w.named(CONTENT, "article article article main div div section", inside + "".join(late), ' data-main="1"')
    if draw.random() < 0.2:
        main = f"<main>{main}</main>"
    if draw.random() < 0.08:
        main = f'<div data-main="1">{inside}</div>'
    before = [part() for part, share in ((w.notice, 0.25), (w.header, 0.5), (w.menu, 0.7), (w.advert, 0.5), (w.form, 0.2)) if draw.random() < share]
    after = [part() for part, share in ((w.comments, 0.3), (w.side, 0.45), (w.advert, 0.3), (w.form, 0.2), (w.share, 0.15), (w.footer, 0.8), (w.notice, 0.1))
             if draw.random() < share]
    if draw.random() < 0.5:
        draw.shuffle(before)
    if draw.random() < 0.15:
        before.append(after.pop(0) if after else w.side())
    page = w.plain("".join(before)) + w.plain(main) + w.plain("".join(after))
    return f"<html><head><title>{w.words(2, 6)}</title></head><body>{w.plain(page)}" + draw.choice(["</body></html>", ""])


def labelled_pages(pages: int, seed: int) -> list[str]:
    return [labelled_page(seed + n) for n in range(pages)]
