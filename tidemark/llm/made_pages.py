"""Labelled pages for training: given paragraphs laid out by random page designs.

The parts of a page bear ``data-part=keep`` or ``data-part=drop``, so the label of every
node is known. Designs vary the elements, names, order and nesting of parts; names may be missing
or say nothing, so that a model must also learn from density, position and siblings. The
texts of all parts come from the same paragraphs: wording gives nothing away.
"""

from __future__ import annotations

import html

#: Names that sites give to parts, and the elements they use for them.
PARTS = {
    "article": ("article post entry story content main body text blog news single detail page", "article div main section div"),
    "wrap": ("wrapper container page site layout row grid inner content main outer", "div main section div"),
    "menu": ("nav menu navigation navbar topbar links menubar breadcrumb breadcrumbs pagination pager tabs toc", "nav div ul header nav"),
    "header": ("header masthead banner top branding logo site head hero", "header div"),
    "footer": ("footer foot bottom colophon copyright legal imprint", "footer div footer section"),
    "side": ("sidebar side aside widget related recommended popular trending rail secondary more teaser promo archive categories", "aside div section"),
    "notice": ("cookie cookies consent notice gdpr alert privacy modal overlay popup message warning announcement paywall banner", "div section aside dialog p"),
    "ad": ("ad ads advert advertisement sponsored sponsor promo promotion banner adsense commercial", "div aside section p figure"),
    "form": ("form newsletter subscribe signup login search contact registration", "form form div"),
    "comments": ("comments comment respond reply replies discussion feedback thread reviews responses", "div section ol aside"),
    "share": ("share social sharing follow buttons tools actions", "div ul p"),
}
NOISE = "row col grid clearfix container css block module box inner item js list unit l u x".split()


class Maker:
    def __init__(self, rng, paragraphs: list[str]):
        self.rng = rng
        self.paragraphs = [p for p in paragraphs if p.split()] or ["Words of a text.", "More words, then some more of them."]

    def words(self, least: int, most: int) -> str:
        words = self.rng.choice(self.paragraphs).split()
        n = self.rng.randint(least, most)
        at = self.rng.randrange(max(1, len(words) - n + 1))
        return html.escape(" ".join(words[at : at + n]), quote=False)

    def sentences(self, most: int) -> str:
        return " ".join(self.words(3, 18).rstrip(".,") + "." for _ in range(self.rng.randint(1, most)))

    def names(self, part: str, sure: bool = False) -> str:
        r = self.rng
        noise = r.choice(NOISE) + r.choice(["", "-md-4", "-12", "_x7f", "-a1b2"])
        if not sure and r.random() < 0.25:
            return r.choice(["", f' class="{noise}"', ' style="margin:0"'])
        known = PARTS[part][0].split()
        name = r.choice(known[:6] if r.random() < 0.6 else known)
        if r.random() < 0.4:
            name = r.choice(["{0}-{1}", "{1}-{0}", "{0}_{1}", "c-{0}__{1}", "{0}{2}"]).format(
                name, r.choice([*known, "area", "section", "inner", "list"]), "Box"
            )
        if r.random() < 0.3:
            name = f"{noise} {name}" if r.random() < 0.5 else f"{name} {noise}"
        return f' {r.choice(["class", "class", "id", "role"])}="{name}"'

    def part(self, part: str, inside: str, keep: bool | None = None, sure: bool = False, tag: str | None = None) -> str:
        tag = tag or self.rng.choice(PARTS[part][1].split())
        semantic = tag in ("article", "nav", "header", "footer", "aside", "form")
        names = "" if semantic and not sure and self.rng.random() < 0.5 else self.names(part, sure)
        mark = "" if keep is None else f" data-part={'keep' if keep else 'drop'}"
        return f"<{tag}{names}{mark}>{inside}</{tag}>"

    def links(self, most: int = 9) -> str:
        r = self.rng
        one = [f'<a href="/{k}">{self.words(1, 4)}</a>' for k in range(r.randint(2, most))]
        style = r.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" if style < 0.5 else f"<li>{x}" for x in one) + "</ul>"
        return r.choice([" | ", " ", " &middot; ", "<br>"]).join(one)

    def menu(self) -> str:
        return self.part("menu", self.links(), False)

    def header(self) -> str:
        r = self.rng
        inside = r.choice(["<h1>{}</h1>", '<a href="/">{}</a>', "<p>{}</p>", "<div>{}</div>"]).format(self.words(1, 4))
        inside += f"<p>{self.words(2, 8)}</p>" * (r.random() < 0.4)
        inside += self.links(6) * (r.random() < 0.4) + self.form() * (r.random() < 0.2)
        return self.part("header", inside, False)

    def footer(self) -> str:
        r = self.rng
        inside = r.choice(["&copy; ", "&copy; 2024 ", "", "(c) "]) + self.words(1, 5)
        inside += r.choice([" &middot; ", "<br>", " "]) + self.sentences(2) * (r.random() < 0.6)
        inside = r.choice(["<p>{}</p>", "{}", "<div>{}</div>"]).format(inside)
        return self.part("footer", inside + self.links(6) * (r.random() < 0.5), False, tag=r.choice(["footer", "footer", "div"]))

    def form(self) -> str:
        r = self.rng
        fields = "".join(f"<label>{self.words(1, 3)}</label><input name=f{k}>" for k in range(r.randint(1, 4)))
        lead = r.choice(["<p>{}</p>", "<h3>{}</h3>", "{}"]).format(self.sentences(2)) * (r.random() < 0.6)
        return self.part("form", f"{lead}{fields}<button>{self.words(1, 2)}</button>", False)

    def notice(self, sure: bool = False) -> str:
        r = self.rng
        text = r.choice(["<p>{}</p>", "{}", "<span>{}</span>"]).format(self.sentences(4))
        tail = r.choice(["", "<button>ok</button>", f'<a href="/p">{self.words(1, 3)}</a>'])
        return self.part("notice", text + tail, False, sure, r.choice(["div", "div", "section", "aside", "dialog"]))

    def ad(self, sure: bool = False) -> str:
        r = self.rng
        text = self.sentences(4) if r.random() < 0.7 else f'<a href="/buy">{self.words(2, 12)}</a>'
        tag = r.choice(["div", "div", "aside", "section", "p"])
        if tag != "p" and r.random() < 0.4:
            text = f"<p>{text}</p>"
        return self.part("ad", text, False, sure, tag)

    def side(self, sure: bool = False) -> str:
        r = self.rng
        boxes = []
        for _ in range(r.randint(1, 4)):
            head = f"<h{r.randint(2, 4)}>{self.words(1, 4)}</h3>" * (r.random() < 0.7)
            body = self.links(8) if r.random() < 0.6 else "".join(f"<p>{self.sentences(3)}</p>" for _ in range(r.randint(1, 3)))
            boxes.append(head + body if r.random() < 0.5 else f"<div>{head}{body}</div>")
        return self.part("side", "".join(boxes), False, sure)

    def share(self) -> str:
        return self.part("share", self.links(5), False, True)

    def comments(self, sure: bool = True) -> str:
        r = self.rng
        one = r.choice(["<li{n}>{a}{t}</li>", "<div{n}>{a}{t}</div>", "<article{n}>{a}{t}</article>"])
        many = [
            one.format(
                n=self.names("comments") if r.random() < 0.6 else "",
                a=r.choice(["<b>{}</b> ", "<p>{}</p>", "<header>{}</header>", '<a href="/u">{}</a> ', "<footer>{}</footer>"]).format(self.words(1, 2)),
                t="".join(f"<p>{self.sentences(4)}</p>" for _ in range(r.randint(1, 3))) if r.random() < 0.8 else self.sentences(3),
            )
            for _ in range(r.randint(1, 8))
        ]
        head = f"<h{r.randint(2, 4)}>{self.words(1, 3)}</h3>" * (r.random() < 0.7)
        return self.part("comments", head + "".join(many) + self.form() * (r.random() < 0.4), False, sure)

    def inline(self, text: str) -> str:
        words = text.split()
        if len(words) > 6 and self.rng.random() < 0.3:
            k = self.rng.randrange(len(words) - 3)
            words[k] = self.rng.choice(["<b>{}</b>", '<a href="/x">{}</a>', "<em>{}</em>", '<span class="hl">{}</span>']).format(words[k])
        return " ".join(words)

    def paragraph(self) -> str:
        r = self.rng
        kind = r.random()
        text = html.escape(r.choice(self.paragraphs), quote=False) if r.random() < 0.6 else self.sentences(4)
        text = self.inline(text) if r.random() > 0.06 else self.words(1, 2)
        if kind < 0.68:
            return f"<p>{text}</p>"
        if kind < 0.72:
            return f"<p><b>{text}<br>"
        if kind < 0.76:
            return f"<div>{text}</div>"
        if kind < 0.82:
            return f"<h{r.randint(2, 4)}>{self.words(1, 6)}</h2>"
        if kind < 0.88:
            items = [self.inline(self.sentences(2)) if r.random() < 0.7 else f'<a href="/i">{self.words(1, 5)}</a>' for _ in range(r.randint(1, 6))]
            return r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{x}</li>" for x in items))
        if kind < 0.91:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.94:
            rows = "".join("<tr>" + "".join(f"<td>{self.words(1, 3)}" for _ in range(3)) for _ in range(r.randint(1, 4)))
            return f"<table>{rows}</table>"
        if kind < 0.96:
            return f"<pre>{text}</pre>"
        return f'<figure><img src="x"><figcaption>{self.words(2, 9)}</figcaption></figure>'

    def article(self) -> str:
        r = self.rng
        parts = [self.paragraph() for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14, 25]))]
        if r.random() < 0.2:
            parts = ["<br><br>".join(self.sentences(5) for _ in range(r.randint(1, 5)))]
        if r.random() < 0.75:
            title = f"<h{r.choice([1, 1, 1, 2])}>{self.words(1, 12)}</h1>"
            parts.insert(0, f"<header>{title}</header>" if r.random() < 0.15 else title)
        body = [self.part("article", "".join(parts), tag="div")] if r.random() < 0.25 else parts
        inserts = (lambda: self.ad(True), self.share, lambda: self.side(True), self.form, lambda: self.notice(True), self.menu)
        while r.random() < 0.35:
            body.insert(r.randint(0, len(body)), r.choice(inserts)())
        if r.random() < 0.15:
            body.append(self.comments())
        return self.part("article", "".join(body), True)

    def page(self) -> str:
        r = self.rng
        middle = [self.article()] if r.random() < 0.95 else []
        middle += [self.comments(r.random() < 0.8)] * (r.random() < 0.35) + [self.share()] * (r.random() < 0.15)
        around = (self.side, self.ad, self.menu, self.notice)
        while r.random() < 0.45:
            middle.insert(r.randint(0, len(middle)), r.choice(around)())
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            middle = [self.part("wrap", "".join(middle))]
        top = [f() for f in r.sample([self.header, self.menu, self.notice, self.ad], r.randint(0, 3))]
        end = [f() for f in r.sample([self.footer, self.footer, self.notice, self.menu, self.side], r.randint(0, 3))]
        body = "".join(top + middle + end)
        if r.random() < 0.08:
            body = f"<table><tr><td>{self.menu()}</td><td>{body}</td></tr></table>"
        ends = "</body></html>" if r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title><script>f('</p>')</script></head><body>{body}{ends}"
