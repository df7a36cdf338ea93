"""Fits the block labeller of ``html`` on generated pages: ``python -m lamina.llm.html_training``.

The pages are made by a grammar of layouts (semantic elements, named and unnamed div soup,
boilerplate inside and around the main text), with invented words; each block carries its
label.  No crawled data is used, so the fit is bounded by PAGES and repeatable.
"""

from __future__ import annotations

import html as _html
import random

import numpy as np

from .html import PATH_BUCKETS, SHAPES, WEIGHTS, WORD_BUCKETS, _means, blocks_of, features, lstm, predict, sigmoid

PAGES, HIDDEN, PATH_SIZE, WORD_SIZE, STEPS, BATCH = 6000, 24, 16, 8, 1400, 32
MARK = "⁣"  # an invisible separator at the end of main text, so blocks know their label

# Usual names of containers, by what they hold.
MAIN = "content post entry article body story text main post-content entry-content article-body story-text page-content hentry prose markdown".split()
NAV = "nav menu navbar navigation main-menu topnav breadcrumb breadcrumbs pagination pager toc sitemap links skip".split()
TOP = "header masthead top site-header page-header brand logo tagline hero topbar".split()
FOOT = "footer foot bottom site-footer page-footer copyright legal colophon".split()
SIDE = "sidebar side aside rail widget related recommended popular trending tags archive categories author-box right-column left-column".split()
ADS = "ad ads advert advertisement advertising promo promotion sponsor sponsored sponsored-content adsense banner-ad ad-slot commercial teaser".split()
NOTICE = "notice cookie cookie-notice cookies consent gdpr banner alert warning popup modal overlay message announcement disclaimer paywall toast".split()
COMMENTS = "comment comments comment-list commentlist reply replies discussion responses disqus user-comments comments-area feedback thread".split()
FORMS = "newsletter subscribe signup search login contact-form subscription search-form register".split()
SHARE = "share social share-buttons sharing follow social-links like-box".split()
CUES = {
    "nav": "home about contact news archive next previous login".split(), "foot": "copyright rights reserved terms privacy contact imprint".split(),
    "ads": "advertisement sponsored buy now offer deal sale".split(), "notice": "we use cookies accept settings this site consent".split(),
    "comments": "reply said wrote posted comments ago like".split(), "forms": "email subscribe submit search name send".split(), "share": "share tweet facebook print".split(),
}


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        parts = ["".join(self.r.choice("bcdfghlmnprstvz") + self.r.choice("aeiouéü") for _ in range(self.r.randint(1, 2))) for _ in range(60)]
        self.vocabulary = ["".join(self.r.choice(parts) for _ in range(self.r.randint(1, 3))) for _ in range(400)]

    def prose(self, low: int, high: int, cue: str | None = None) -> str:
        words = [self.r.choice(self.vocabulary) for _ in range(self.r.randint(low, high))]
        if cue and self.r.random() < 0.5:
            for w in self.r.sample(CUES[cue], min(len(CUES[cue]), self.r.randint(1, 4))):
                words.insert(self.r.randint(0, len(words)), w)
        out, start = [], True
        for w in words:
            out.append(w.capitalize() if start else w)
            start = self.r.random() < 0.1
            if start:
                out[-1] += "."
            elif self.r.random() < 0.06:
                out[-1] += self.r.choice(",,,;:")
        noise = self.r.random()
        if noise < 0.06:
            out = [w + self.r.choice(["***", "###", "%%%", "$$$", "&&&"]) for w in out]
        return " ".join(out) + self.r.choice([".", ".", ".", "", "!"])

    def named(self, names: list[str], strange: bool) -> str:
        if strange:
            return f' class="x{self.r.randint(1, 999)}"' if self.r.random() < 0.5 else ""
        name = self.r.choice(names)
        if self.r.random() < 0.3:
            name += self.r.choice(["-wrapper", "-box", "-area", "-inner", " clearfix", " col-8", "_1"])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def inline(self, text: str) -> str:
        words = _html.escape(text, quote=False).split(" ")
        for _ in range(self.r.choice([0, 0, 0, 1, 2])):
            i = self.r.randrange(len(words))
            tag = self.r.choice(["b", "i", "em", "strong", 'a href="/x"', "span", "code"])
            words[i] = f"<{tag}>{words[i]}</{tag.split()[0]}>"
        joined = " ".join(words)
        return f"<b>{joined}<br>" if self.r.random() < 0.05 else joined

    def links(self, n: int, cue: str) -> str:
        items = "".join(f'<li><a href="/{i}">{_html.escape(self.prose(1, 4, cue))}</a></li>' for i in range(n))
        return f"<ul>{items}</ul>" if self.r.random() < 0.8 else "".join(f'<a href="/{i}">{_html.escape(self.prose(1, 3, cue))}</a> ' for i in range(n))

    def filler(self, cue: str | None, low: int = 3, high: int = 40) -> str:
        texts = [self.inline(self.prose(low, high, cue)) for _ in range(self.r.choice([1, 1, 1, 2, 3]))]
        shape = self.r.random()
        if shape < 0.4:
            return " ".join(texts[:1])
        if shape < 0.85:
            return "".join(f"<p>{t}</p>" for t in texts)
        return f"<h3>{self.inline(self.prose(1, 4, cue))}</h3>" + "".join(f"<p>{t}</p>" for t in texts)

    def boilerplate(self, strange: bool) -> str:
        kind = self.r.choice(["side", "side", "ads", "ads", "notice", "notice", "forms", "share", "comments"])
        if kind == "side":
            tag = self.r.choice(["aside", "aside", "div", "section"])
            name = "" if tag == "aside" and self.r.random() < 0.5 else self.named(SIDE, strange)
            inner = self.links(self.r.randint(2, 8), "nav") if self.r.random() < 0.5 or strange else self.filler(None)
            return f"<{tag}{name}>{inner}</{tag}>"
        if kind == "ads":
            return f"<div{self.named(ADS, False)}>{self.filler('ads')}</div>"
        if kind == "notice":
            tag = self.r.choice(["div", "div", "section", "p", "aside"])
            role = ' role="alert"' if self.r.random() < 0.2 else self.named(NOTICE, False)
            return f"<{tag}{role}>{self.inline(self.prose(4, 35, 'notice'))}</{tag}>"
        if kind == "forms":
            name = self.named(FORMS, strange) if self.r.random() < 0.6 else ""
            button = self.prose(1, 2, "forms")
            return f'<form{name}><label>{self.prose(1, 5, "forms")}</label><input type="text"><p>{self.prose(3, 25, "forms")}</p><button>{button}</button></form>'
        if kind == "share":
            return f"<div{self.named(SHARE, False)}>{self.links(self.r.randint(2, 5), 'share')}</div>"
        return self.comments()

    def comments(self) -> str:
        tag = self.r.choice(["section", "div", "div", "ol", "ul"])
        inner = "li" if tag in ("ol", "ul") else self.r.choice(["div", "article", "p", "li"])
        each = "".join(f"<{inner}{self.named(COMMENTS, False) if self.r.random() < 0.7 else ''}>" + (self.inline(self.prose(3, 60, 'comments')) if inner == "p" or self.r.random() < 0.5 else f"<p>{self.inline(self.prose(3, 60, 'comments'))}</p>") + f"</{inner}>" for _ in range(self.r.randint(1, 6)))
        title = f"<h2>{self.prose(1, 3, 'comments')}</h2>" if self.r.random() < 0.6 else ""
        return f"<{tag}{self.named(COMMENTS, False)}>{title if tag not in ('ol', 'ul') else ''}{each}</{tag}>"

    def main(self, strange: bool) -> str:
        mark = lambda low, high: self.inline(self.prose(low, high)) + MARK
        out = []
        if self.r.random() < 0.85:
            title = f"<h1>{mark(2, 10)}</h1>"
            out.append(f"<header>{title}</header>" if self.r.random() < 0.1 else title)
        for _ in range(self.r.choice([1, 2, 3, 4, 5, 6, 8, 10, 14])):
            x = self.r.random()
            if x < 0.72:
                out.append(f"<p>{mark(1, 120)}" + ("</p>" if self.r.random() < 0.9 else ""))
            elif x < 0.8:
                tag = self.r.choice(["h2", "h3", "h4"])
                out.append(f"<{tag}>{mark(1, 8)}</{tag}>")
            elif x < 0.87:
                tag = self.r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{mark(1, 30)}</li>" for _ in range(self.r.randint(2, 6))) + f"</{tag}>")
            elif x < 0.9:
                out.append(f"<blockquote>{mark(4, 50)}</blockquote>")
            elif x < 0.92:
                out.append(f"<pre>{mark(3, 30)}</pre>")
            elif x < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{mark(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            else:
                out.append(f"<div>{mark(5, 80)}</div>")
            if self.r.random() < 0.07:
                out.append(self.boilerplate(False))
        return "".join(out)

    def page(self) -> str:
        strange = self.r.random() < 0.15
        body = []
        if self.r.random() < 0.5:
            tag = self.r.choice(["header", "header", "div"])
            inner = self.r.choice([f"<h1>{self.prose(1, 4)}</h1>", f"<p>{self.prose(1, 12)}</p>", self.prose(1, 10), f"<a href='/'>{self.prose(1, 3)}</a>"])
            body.append(f"<{tag}{self.named(TOP, False) if tag == 'div' else ''}>{inner}{self.links(3, 'nav') if self.r.random() < 0.3 else ''}</{tag}>")
        if self.r.random() < 0.8:
            tag = self.r.choice(["nav", "nav", "div", "ul"])
            inner = self.links(self.r.randint(2, 9), "nav")
            body.append(f"<{tag}{self.named(NAV, strange) if tag != 'nav' else ''}>{inner}</{tag}>")
        for _ in range(self.r.choice([0, 0, 1, 1, 2])):
            body.append(self.boilerplate(strange))
        outer = self.r.choice(["article", "article", "article", "main", "div", "div", "section", "main-article"])
        text = self.main(strange)
        if outer == "main-article":
            text = f"<main><article>{text}</article>{self.boilerplate(False) if self.r.random() < 0.3 else ''}</main>"
        else:
            text = f"<{outer}{self.named(MAIN, strange) if outer in ('div', 'section') or self.r.random() < 0.2 else ''}>{text}</{outer}>"
        if self.r.random() < 0.3:
            text = f"<div{self.named(['wrapper', 'container', 'page', 'row', 'site', 'layout', 'wrap', 'columns'], False)}>{text}{self.boilerplate(strange) if self.r.random() < 0.4 else ''}</div>"
        if self.r.random() < 0.96:
            body.append(text)
        for _ in range(self.r.choice([0, 0, 1, 1, 2])):
            body.append(self.boilerplate(strange))
        if self.r.random() < 0.3:
            body.append(self.comments())
        if self.r.random() < 0.8:
            tag = self.r.choice(["footer", "footer", "footer", "div"])
            body.append(f"<{tag}{self.named(FOOT, False) if tag == 'div' else ''}>{self.r.choice([self.links(3, 'foot'), '&copy; ' + self.prose(2, 30, 'foot'), '<p>' + self.prose(2, 30, 'foot') + '</p>'])}</{tag}>")
        return f"<!DOCTYPE html><html><head><title>{self.prose(1, 8)}</title></head><body>{''.join(body)}</body></html>"


def examples(n: int, seed: int) -> list[tuple[list, np.ndarray]]:
    out, vary = [], random.Random(seed)
    while len(out) < n:
        blocks = blocks_of(Maker(vary.randrange(1 << 30)).page())
        labels = np.array([MARK in b.text for b in blocks], np.float32)
        for b in blocks:
            b.text = b.text.replace(MARK, "").strip() or "-"
        if blocks:
            out.append((blocks, labels))
    return out


def _backward(x, mask, w, u, trace, dh_out):
    """Gradients of one direction given those of its outputs."""
    size = u.shape[0]
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * size, np.float32), np.zeros_like(x)
    dh, dc = np.zeros((x.shape[0], size), np.float32), np.zeros((x.shape[0], size), np.float32)
    for t in range(x.shape[1] - 1, -1, -1):
        h, c, i, f, o, g, s = trace[t]
        m = mask[:, t, None]
        dh = dh + dh_out[:, t]
        dn = m * dh
        dcn = m * dc + dn * o * (1 - s * s)
        dz = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), dn * s * o * (1 - o), dcn * i * (1 - g * g)], axis=1)
        dw += x[:, t].T @ dz
        du += h.T @ dz
        db += dz.sum(0)
        dx[:, t] = dz @ w.T
        dh = (1 - m) * dh + dz @ u.T
        dc = (1 - m) * dc + dcn * f
    return dw, du, db, dx


def start(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    n = PATH_SIZE + WORD_SIZE + SHAPES
    draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
    w = {"path": draw(PATH_BUCKETS, PATH_SIZE, scale=0.5), "word": draw(WORD_BUCKETS, WORD_SIZE, scale=0.1)}
    for d in "fb":
        w |= {f"w{d}": draw(n, 4 * HIDDEN, scale=0.2), f"u{d}": draw(HIDDEN, 4 * HIDDEN, scale=0.2), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
        w[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
    return w | {"out": draw(2 * HIDDEN + n, 1, scale=0.2), "bias": np.zeros(1, np.float32)}


def gradients(batch, weights):
    """(loss, gradients) of a batch of (paths, words, shapes, labels)."""
    longest = max(len(b[3]) for b in batch)
    n = weights["wf"].shape[0]
    x, mask, y = np.zeros((len(batch), longest, n), np.float32), np.zeros((len(batch), longest), np.float32), np.zeros((len(batch), longest), np.float32)
    for j, (paths, words, shapes, labels) in enumerate(batch):
        k = len(labels)
        x[j, :k] = np.concatenate([_means(weights["path"], paths), _means(weights["word"], words), shapes], axis=1)
        mask[j, :k], y[j, :k] = 1, labels
    tf, tb = [], []
    xr, mr = x[:, ::-1], mask[:, ::-1]
    hf, hb = lstm(x, mask, weights["wf"], weights["uf"], weights["bf"], tf), lstm(xr, mr, weights["wb"], weights["ub"], weights["bb"], tb)[:, ::-1]
    z = np.concatenate([hf, hb, x], axis=2)
    p = sigmoid(z @ weights["out"] + weights["bias"])[..., 0]
    loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / mask.sum()
    d = (mask * (p - y) / mask.sum())[..., None].astype(np.float32)
    g = {"out": np.einsum("bti,bto->io", z, d), "bias": d.sum((0, 1))}
    dz = d @ weights["out"].T
    g["wf"], g["uf"], g["bf"], dxf = _backward(x, mask, weights["wf"], weights["uf"], tf, dz[..., :HIDDEN])
    g["wb"], g["ub"], g["bb"], dxb = _backward(xr, mr, weights["wb"], weights["ub"], tb, dz[..., HIDDEN : 2 * HIDDEN][:, ::-1])
    dx = dz[..., 2 * HIDDEN :] + dxf + dxb[:, ::-1]
    for name, which, low, size in (("path", 0, 0, PATH_SIZE), ("word", 1, PATH_SIZE, WORD_SIZE)):
        g[name] = np.zeros_like(weights[name])
        for j, b in enumerate(batch):
            for i, ids in enumerate(b[which]):
                if ids:
                    np.add.at(g[name], ids, dx[j, i, low : low + size] / len(ids))
    return loss, g


def train(pages: int = PAGES, steps: int = STEPS, seed: int = 5) -> dict[str, np.ndarray]:
    data = [(*features(blocks), labels) for blocks, labels in examples(pages, seed)]
    weights, rng = start(), np.random.default_rng(seed)
    first, second = {k: np.zeros_like(v) for k, v in weights.items()}, {k: np.zeros_like(v) for k, v in weights.items()}
    for step in range(1, steps + 1):
        loss, g = gradients([data[i] for i in rng.integers(0, len(data), BATCH)], weights)
        rate = 0.01 * min(1, 3 * (1 - step / (steps + 1)))
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k, v in g.items():
            v = v * min(1, 5 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.999 * second[k] + 0.001 * v * v
            weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        if step % 100 == 0:
            print(step, round(float(loss), 4), flush=True)
    return weights


def accuracy(weights: dict[str, np.ndarray], pages: int = 400, seed: int = 77) -> float:
    """Share of blocks of pages not trained on that get their label."""
    right = total = 0
    for blocks, labels in examples(pages, seed):
        x = np.concatenate([_means(weights["path"], (f := features(blocks))[0]), _means(weights["word"], f[1]), f[2]], axis=1)[None]
        p = predict(x.astype(np.float32), np.ones(x.shape[:2], np.float32), weights)[0]
        right += ((p >= 0.5) == (labels > 0.5)).sum()
        total += len(labels)
    return right / total


if __name__ == "__main__":
    fitted = train()
    print("held-out accuracy", accuracy(fitted))
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float32) for k, v in fitted.items()})
