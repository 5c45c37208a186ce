"""Labelled pages for the extraction model, generated from a seed: invented words in many page layouts, all freely combined.

The label of a node is 1 if any of its text belongs to the article. Article text carries a mark that is taken out again.
"""

from __future__ import annotations

import random

from auditloom.llm.html_nodes import Nodes, parse

MARK = ""
#: pages that the model is fitted on, and those that it is judged on
PAGES, SEED = 1200, 11


class Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.lexicon = ["".join(self.r.choice("th an er on re in ti sh ou le men que der sch ar os ci".split()) for _ in range(self.r.randint(1, 4))) for _ in range(300)]
        self.noisy = self.r.random() < 0.15

    def words(self, n: int) -> str:
        out = [self.r.choice(self.lexicon) for _ in range(max(1, n))]
        if self.noisy:
            out = [w + self.r.choice(["###", "***", "&amp;&amp;", "%%%", "!!"]) for w in out]
        return " ".join(out)

    def prose(self, least: int = 1, most: int = 8) -> str:
        count = self.r.randint(least, most)
        return " ".join(self.words(self.r.choice([1, 3, 6, 9, 14, 22])).capitalize() + self.r.choice("....!?,") for _ in range(count))

    def named(self, *names: str, often: float = 0.75) -> str:
        """A class or id attribute of one of the names, or a meaningless one, or none."""
        x = self.r.random()
        if x < often:
            name = self.r.choice(names)
            if self.r.random() < 0.3:
                name = self.r.choice([f"{name}-{self.r.choice(['box', 'wrap', 'inner', 'area'])}", f"js-{name}", f"{name} {self.words(1)}"])
            return f' {self.r.choice(["class", "class", "id"])}="{name}"'
        return f' class="{self.words(1)}{self.r.randint(1, 99)}"' if x < often + 0.15 else ""

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{self.words(1)}">{self.words(self.r.randint(1, 3))}</a></li>' for _ in range(n))

    def menu(self) -> str:
        ul = f"<ul>{self.links(self.r.randint(3, 9))}</ul>"
        return self.r.choice([f"<nav>{ul}</nav>", f"<nav{self.named('nav', 'menu', 'navbar')}>{ul}</nav>", f"<div{self.named('nav', 'menu', 'navigation', 'breadcrumbs')}>{ul}</div>", f"<div{self.named('menu', 'breadcrumb')}>" + " &raquo; ".join(f'<a href="#">{self.words(1)}</a>' for _ in range(4)) + "</div>"])

    def header(self) -> str:
        inner = f"<h1{self.named('site-title', 'logo', often=0.5)}>{self.words(2)}</h1>" if self.r.random() < 0.4 else f'<a href="/">{self.words(2)}</a>'
        inner += f"<p>{self.words(self.r.randint(3, 9))}</p>" if self.r.random() < 0.5 else ""
        inner += self.menu() if self.r.random() < 0.4 else ""
        return self.r.choice([f"<header>{inner}</header>", f"<header{self.named('header', 'masthead', 'top')}>{inner}</header>", f"<div{self.named('header', 'masthead', 'topbar', often=0.95)}>{inner}</div>"])

    def footer(self) -> str:
        inner = self.r.choice([f"&copy; {self.words(2)} &middot; {self.prose(1, 3)}", f"<p>&copy; 20{self.r.randint(10, 29)} {self.words(3)}. {self.prose(1, 2)}</p><ul>{self.links(4)}</ul>", f"<p>{self.prose(1, 3)}</p>"])
        return self.r.choice([f"<footer>{inner}</footer>", f"<footer{self.named('footer')}>{inner}</footer>", f"<div{self.named('footer', 'legal', 'copyright', often=0.95)}>{inner}</div>"])

    def advert(self) -> str:
        inner = self.r.choice([self.prose(1, 3), f"<p>{self.prose(1, 4)}</p>", f'<a href="//x">{self.words(5)}</a>', f"<h3>{self.words(3)}</h3><p>{self.prose(1, 3)}</p>"])
        return f"<{(t := self.r.choice(['div', 'div', 'aside', 'section']))}{self.named('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner', often=0.97)}>{inner}</{t}>"

    def notice(self) -> str:
        inner = self.r.choice([self.prose(1, 3), f"<p>{self.prose(1, 3)}</p><button>{self.words(1)}</button>", f"<p>{self.prose(1, 2)} <a href='#'>{self.words(2)}</a></p>"])
        return f"<{(t := self.r.choice(['div', 'section', 'aside']))}{self.named('cookie-notice', 'cookie', 'notice', 'consent', 'alert', 'gdpr', often=0.97)}>{inner}</{t}>"

    def sidebar(self) -> str:
        inner = "".join(self.r.choice([f"<h3>{self.words(2)}</h3><ul>{self.links(self.r.randint(3, 7))}</ul>", f"<div{self.named('widget', 'related', often=0.6)}><h4>{self.words(2)}</h4><p>{self.prose(1, 4)}</p></div>", f"<p>{self.prose(1, 4)}</p>"]) for _ in range(self.r.randint(1, 3)))
        return self.r.choice([f"<aside>{inner}</aside>", f"<aside{self.named('sidebar', 'related')}>{inner}</aside>", f"<div{self.named('sidebar', 'side', 'related', 'widget', often=0.97)}>{inner}</div>"])

    def form(self) -> str:
        inner = f"<label>{self.words(2)}</label><input type='text'><button>{self.words(1)}</button>"
        inner += f"<p>{self.prose(1, 2)}</p>" if self.r.random() < 0.5 else ""
        inner += f"<select><option>{self.words(1)}</option><option>{self.words(1)}</option></select>" if self.r.random() < 0.3 else ""
        form = f"<form{self.named('search', 'newsletter', 'login', 'signup', often=0.5)}>{inner}</form>"
        return f"<div{self.named('newsletter', 'subscribe', 'search')}><h3>{self.words(2)}</h3>{form}</div>" if self.r.random() < 0.4 else form

    def comments(self) -> str:
        one = lambda: self.r.choice([f"<p>{self.prose(1, 5)}</p>", f"<b>{self.words(1)}</b><p>{self.prose(1, 4)}</p>", f"<div{self.named('comment-body', 'comment')}>{self.prose(1, 5)}</div>"])
        many = self.r.randint(1, 8)
        lists = f"<ol>{''.join(f'<li{self.named("comment", "reply", often=0.6)}>{one()}</li>' for _ in range(many))}</ol>"
        flat = "".join(f"<div{self.named('comment', 'reply', often=0.8)}>{one()}</div>" for _ in range(many))
        top = f"<h2>{self.words(2)}</h2>" if self.r.random() < 0.6 else ""
        return f"<{(t := self.r.choice(['div', 'section', 'section']))}{self.named('comments', 'comments', 'disqus', 'replies', often=0.97)}>{top}{self.r.choice([lists, flat])}</{t}>"

    def emphasised(self) -> str:
        """A paragraph with inline markup somewhere in it, sometimes left open."""
        tag = self.r.choice("b i em strong span a u code".split())
        parts = [self.prose(1, 2) if self.r.random() < 0.5 else "", f"<{tag}>{self.prose(1, 3)}" + (f"</{tag}>" if self.r.random() < 0.7 else ""), self.prose(1, 2) if self.r.random() < 0.5 else ""]
        text = self.r.choice([" ", "<br>", "<br/>"]).join(x for x in parts if x)
        return f"<p>{MARK}{text}" + self.r.choice(["</p>", "</p>", "\n"])

    def head(self) -> str:
        parts = [f"<title>{self.words(5)}</title>", f'<meta name="description" content="{self.words(6)}">', '<link rel="stylesheet" href="/main.css">', f"<style>.{self.words(1)} {{ color: #333 }}</style>", f'<script type="application/ld+json">{{"name": "{self.words(2)}"}}</script>', "<script>window.dataLayer = [];</script>"]
        self.r.shuffle(parts)
        return f"<head>{''.join(parts[: self.r.randint(1, len(parts))])}</head>"

    def article(self) -> str:
        r, m = self.r, MARK
        out = [f"<{(h := r.choice(['h1', 'h1', 'h2']))}>{m}{self.words(r.randint(3, 14))}</{h}>"] if r.random() < 0.9 else []
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12, 20])):
            x = r.random()
            if x < 0.68:
                out.append(f"<p>{m}{self.prose()}" + r.choice(["</p>", "</p>", "</p>", "<br>", "\n"]))
            elif x < 0.76:
                out.append(self.emphasised())
            elif x < 0.82:
                out.append(f"<h{(k := r.randint(2, 4))}>{m}{self.words(r.randint(1, 6))}</h{k}>")
            elif x < 0.87:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{m}{self.prose(1, 2)}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>")
            elif x < 0.91:
                out.append(f"<blockquote>{r.choice(['<p>', ''])}{m}{self.prose(1, 3)}</blockquote>")
            elif x < 0.93:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{m}{self.words(2)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif x < 0.95:
                out.append(f"<pre>{m}{self.prose(1, 3)}</pre>")
            else:
                out.append(f'<p>{m}{self.prose(1, 2)} <a href="/x">{self.words(2)}</a> {self.prose(1, 3)}</p>')
            if r.random() < 0.07:
                out.append(r.choice([self.advert, self.form, self.notice])())
        if len(out) < 2:
            out.append(f"<p>{m}{self.prose(1, 3)}</p>")
        if r.random() < 0.15:
            out.append(self.comments())
        inner = "".join(out)
        inner = f"<div{self.named('content', 'entry', 'post', often=0.5)}>{inner}</div>" if r.random() < 0.3 else inner
        return r.choice([f"<article>{inner}</article>", f"<article{self.named('post', 'article', 'entry')}>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f"<div{self.named('content', 'article', 'post', 'main', 'story', 'entry', often=0.85)}>{inner}</div>", f"<section{self.named('content', 'article', 'story')}>{inner}</section>"])

    def html(self) -> str:
        r = self.r
        some = lambda f, p: f() if r.random() < p else ""
        before = [some(self.notice, 0.3), some(self.header, 0.6), some(self.menu, 0.7), some(self.advert, 0.5), some(self.form, 0.2)]
        after = [some(self.comments, 0.35), some(self.sidebar, 0.4), some(self.advert, 0.3), some(self.form, 0.25), some(self.notice, 0.15), some(self.footer, 0.85)]
        side = some(self.sidebar, 0.15)
        if r.random() < 0.3:
            r.shuffle(before)
        body = "".join(before) + side + self.article() + "".join(after)
        if r.random() < 0.35:
            body = f"<div{self.named('page', 'wrapper', 'container', 'site', often=0.6)}>{body}</div>"
        script = "<script>if (1 < 2) { load(); }</script>" if r.random() < 0.3 else ""
        opened = r.choice(["<!DOCTYPE html><html>", "<html>", '<!doctype html>\n<html class="no-js">'])
        return f"{opened}{self.head()}<body>{body}{script}" + r.choice(["</body></html>", ""])


def labelled_page(seed: int) -> tuple[Nodes, list[int]]:
    page = parse(Page(seed).html())
    label = [int(bool(t and MARK in t)) for t in page.text]
    page.text = [t and " ".join(t.replace(MARK, "").split()) for t in page.text]
    for k in range(len(label) - 1, 0, -1):
        label[page.parent[k]] |= label[k]
    return page, label
