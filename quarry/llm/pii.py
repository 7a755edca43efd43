"""Personal data: fixed patterns plus a character-level BiLSTM-CRF trained in numpy.

The model tags characters with the beginning and inside of four kinds of spans.
It is trained once a process, from texts that :func:`labelled` makes with their
spans: the four kinds in many spellings, among words and numbers, codes and signs
that look alike. A text is cut into overlapping windows, which are decoded by
themselves and put together over the whole text: each place has the tag of the
window in which it lies farthest from an edge, so a span that one window cuts is
continued by the tags of the next, whatever its length. A span of these kinds holds
a digit or an @ sign, so only windows with one, and those beside them, are decoded.

The fixed patterns' spans always stay. The model decides what else is one; of its
spans those stay that overlap no other and hold what their kind must hold (numbers
in range, check digit, an @ sign and a point).

Defined results: a null text is empty; repeated rows get equal results; other
columns are ignored; an empty table gives an empty result; offsets are code
points. Time grows with the length of a text and the number of its spans.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")

#: Fixed patterns of the contract.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}

SIGNS = {"email": "@", "phone": "+"}

_DIGIT = re.compile("[0-9]")
_TRIGGER = re.compile("[0-9@]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind: str, s: str) -> bool:
    """The kind's own test of a match."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(digits(s)) <= 19 and luhn(digits(s))
    return kind != "phone" or 9 <= len(digits(s)) <= 15


def _emails(text: str):
    """The email pattern's matches, found from the @ signs; the same as finditer without its retries at each character."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and _LOCAL.match(text, begin - 1, begin):
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans that pass, by kind as listed and then start."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for kind in KINDS[1:]:
        if SIGNS.get(kind, "") in text:
            found += [(kind, m.start(), m.end()) for m in PATTERNS[kind].finditer(text) if passes(kind, m[0])]
    return found


# ---------------------------------------------------------------- the model

TAGS = 1 + 2 * len(KINDS)  # outside, then beginning and inside of each kind
WINDOW, STRIDE = 192, 96  # what is decoded
TRAINED = 112  # what the model is trained on
HIDDEN, INPUT = 24, 14

#: Characters with a class of their own; others fall into digit, lower, upper, white space, other.
OWN = "@.+()-_%:/#,= \n[]\"'$!"
CLASSES = len(OWN) + 5


@lru_cache(maxsize=1)
def _class_table():
    import numpy as np

    table = np.full(0x250, len(OWN) + 4, np.int8)
    for c in range(len(table)):
        ch = chr(c)
        table[c] = OWN.index(ch) if ch in OWN else len(OWN) + (0 if ch in "0123456789" else 1 if ch.islower() else 2 if ch.isupper() else 3 if ch.isspace() else 4)
    return table


def classes(text: str):
    import numpy as np

    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    table = _class_table()
    return table[np.minimum(codes, len(table) - 1)]


def labelled(n: int, seed: int):
    """``n`` pieces of text with their spans [(kind, start, end)].

    Numbers of 13 to 19 digits that are spelled like cards count as cards here, since
    no tagger of characters can work out a check digit; :func:`passes` does that.
    """
    import random

    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    letters = lambda k: "".join(rng.choice("etaoinshrdlucmfwypvbgk") for _ in range(k))

    def word():
        w = "".join(rng.choice("etaoinshrdluéèüßñ") for _ in range(rng.randint(1, 11)))
        w = rng.choice((w, w, w, w.capitalize(), w.upper()))
        return w + rng.choice(("", "", "", "", "", ",", ".", "###", "%%%", "!!", " |", "***", "$$$", "&&&", ":", ";", "?", ")"))

    def email():
        name = rng.choice((f"{letters(rng.randint(2, 9))}.{d(2)}", letters(rng.randint(1, 12)), f"{letters(4)}_{letters(5)}", f"{letters(3)}+{letters(4)}{d(1)}", f"{letters(1)}.{letters(6)}", f"{letters(5)}-{letters(rng.randint(1, 30))}.{letters(4)}", letters(5).upper(), f"{letters(3)}%{letters(2)}"))
        host = rng.choice((f"mail{d(1)}", letters(rng.randint(1, 10)), f"{letters(3)}-{letters(4)}", f"{letters(3)}{d(2)}", f"{letters(4)}.{letters(6)}", letters(rng.randint(10, 30))))
        point = rng.choice((".",) * 9 + ("[.]", " . "))
        last = rng.choice((f"example{point}com", f"example{point}org", letters(2), letters(3), f"{letters(2)}{point}{letters(2)}", f"{letters(6)}{point}{letters(3)}"))
        return f"{name}{rng.choice(('@',) * 9 + (' @ ', '[@]', '(@)'))}{host}{point}{last}"

    def ip():
        sep = rng.choice((".",) * 8 + ("[.]", " . ", "(.)"))
        return sep.join(str(rng.randint(0, 255)) for _ in range(4))

    def card():
        size = rng.choice((13, 14, 15, 16, 16, 16, 16, 16, 19))
        sep = rng.choice(("", "", "", " ", " ", "-", ".", "_", "/", "  "))
        own = d(size)
        if size == 15 and sep:
            return sep.join((own[:4], own[4:10], own[10:]))
        return sep.join(own[i : i + 4] for i in range(0, size, 4))

    def phone():
        a, b, c, e = d(3), d(3), d(4), rng.choice("123456789")
        return rng.choice((
            f"+{e} ({a}) {b}-{c}", f"+{e} ({a}) {b}-{c}", f"+{d(2)} {a} {d(7)}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+{d(rng.randint(9, 12))}", f"+{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}",
            f"00{d(2)} {d(2)} {d(3)} {d(4)}", f"0{d(2)}/{d(7)}", f"0{d(3)}-{d(6)}", f"({d(4)}) {d(6)}", f"+{d(2)}-{d(3)}-{d(3)}-{d(3)}", f"1-{a}-{b}-{c}", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{d(2)} (0){d(2)} {d(3)} {d(4)}", f"+{d(2)}.{d(3)}.{d(6)}",
        ))

    def other():
        code = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((8, 12, 32, 40, 40))))
        return rng.choice((
            d(rng.randint(1, 8)), d(rng.randint(1, 4)), f"{d(1)}.{d(1)}.", f"{d(2)}.{d(2)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}", code, code.upper(), f'token = "{code}"', f"{letters(5)}={code}",
            f"{d(2)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(4)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}", f"@{word()}", f"{word()} @", f"${d(3)},{d(3)}", f"{d(3)}/{d(4)}", f"{d(1)},{d(3)},{d(3)}", f"{letters(2).upper()}-{d(4)}", f"({d(4)})", f"§ {d(3)}", f"{d(2)}%", f"{d(1)}x{d(2)}", f"#{d(5)}",
            f"{letters(3)}{d(4)}{letters(2)}", f"{d(4)}-{d(4)}", f"{d(3)}-{d(2)}", f"{d(22)}", f"v{d(1)}.{d(1)}.{d(2)}", f"https://{letters(6)}.{letters(3)}/{letters(4)}?{letters(2)}={d(6)}", f"pp. {d(3)}-{d(3)}", f"[{d(2)}]", f"-{d(2)}.{d(3)}", f"{d(3)} {d(3)}", f"{d(1)} {d(2)} {d(1)} {d(3)}",
        ))

    makers = dict(zip(KINDS, (email, ip, card, phone)))
    for _ in range(n):
        text, spans = "", []
        rate = rng.choice((0.15, 0.3))
        while len(text) < TRAINED:
            x = rng.random()
            around = rng.choice(("", "", "", "", "", "()", '""', "[]", "  ", "''"))
            text += around[:1]
            if x < rate:
                kind = rng.choice(KINDS)
                piece = makers[kind]()
                spans.append((kind, len(text), len(text) + len(piece)))
            else:
                piece = other() if x < 2 * rate else word()
            text += piece + around[1:]
            text += rng.choice((" ", " ", " ", " ", " ", "\n", ", ", ". ", "!! ", "### ", "; ", "$$$ "))
        # What the end cuts is left out where its kind can't be told.
        yield text[:TRAINED], [(k, a, min(b, TRAINED)) for k, a, b in spans if b <= TRAINED or (a < TRAINED - 20)]


def tags_of(length: int, spans):
    import numpy as np

    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        tags[a:b] = 2 + 2 * KINDS.index(kind)
        tags[a] -= 1
    return tags


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x, w, u, b, keep: bool = False):
    """States of a forward pass over x (time, batch, input); with ``keep`` also what the backward pass needs."""
    import numpy as np

    time, batch = x.shape[:2]
    n = u.shape[0]
    h, c = np.zeros((batch, n), x.dtype), np.zeros((batch, n), x.dtype)
    out, held = np.empty((time, batch, n), x.dtype), []
    given = x @ w + b
    for t in range(time):
        z = given[t] + h @ u
        gates, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            held.append((h, before, i, f, o, g, tc))
        h = o * tc
        out[t] = h
    return (out, held) if keep else out


def _lstm_back(x, w, u, held, d_out):
    import numpy as np

    time = x.shape[0]
    n = u.shape[0]
    dz_all = np.empty((*x.shape[:2], 4 * n), x.dtype)
    dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    du = np.zeros_like(u)
    for t in reversed(range(time)):
        h, before, i, f, o, g, tc = held[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dz_all[t] = dz
        du += h.T @ dz
        dh, dc = dz @ u.T, dc * f
    flat = dz_all.reshape(-1, 4 * n)
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0), dz_all @ w.T


def _log_sum(x, axis):
    import numpy as np

    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def emissions(model: dict, ids):
    """Scores of tags (time, batch, tag) of class ids (batch, time)."""
    import numpy as np

    x = model["embed"][ids.T]
    fwd = _lstm(x, model["wf"], model["uf"], model["bf"])
    bwd = _lstm(x[::-1], model["wb"], model["ub"], model["bb"])[::-1]
    return np.concatenate([fwd, bwd], axis=2) @ model["out"] + model["out_b"]


def _gradients(model: dict, ids, tags):
    """Mean negative log likelihood a character, and its gradients."""
    import numpy as np

    x = model["embed"][ids.T]
    fwd, held_f = _lstm(x, model["wf"], model["uf"], model["bf"], keep=True)
    bwd, held_b = _lstm(x[::-1], model["wb"], model["ub"], model["bb"], keep=True)
    both = np.concatenate([fwd, bwd[::-1]], axis=2)
    scores = both @ model["out"] + model["out_b"]
    trans, y = model["trans"], tags.T
    time, batch = y.shape
    alpha, beta = [scores[0]], [np.zeros_like(scores[0])]
    for t in range(1, time):
        alpha.append(scores[t] + _log_sum(alpha[-1][:, :, None] + trans[None], 1))
    for t in range(time - 1, 0, -1):
        beta.append(_log_sum(trans[None] + (scores[t] + beta[-1])[:, None, :], 2))
    beta = beta[::-1]
    z = _log_sum(alpha[-1], 1)
    rows = np.arange(batch)
    d_scores, d_trans = np.empty_like(scores), np.zeros_like(trans)
    gold = np.zeros(batch)
    for t in range(time):
        d_scores[t] = np.exp(alpha[t] + beta[t] - z[:, None])
        d_scores[t][rows, y[t]] -= 1
        gold += scores[t][rows, y[t]]
        if t:
            pair = alpha[t - 1][:, :, None] + trans[None] + (scores[t] + beta[t])[:, None, :] - z[:, None, None]
            d_trans += np.exp(pair).sum(0)
            np.add.at(d_trans, (y[t - 1], y[t]), -1)
            gold += trans[y[t - 1], y[t]]
    n = time * batch
    d_scores /= n
    d_both = d_scores @ model["out"].T
    size = fwd.shape[2]
    wf, uf, bf, dx = _lstm_back(x, model["wf"], model["uf"], held_f, d_both[:, :, :size])
    wb, ub, bb, dxb = _lstm_back(x[::-1], model["wb"], model["ub"], held_b, d_both[::-1, :, size:])
    d_embed = np.zeros_like(model["embed"])
    np.add.at(d_embed, ids.T, dx + dxb[::-1])
    grads = {"embed": d_embed, "wf": wf, "uf": uf, "bf": bf, "wb": wb, "ub": ub, "bb": bb, "trans": d_trans / n, "out_b": d_scores.sum((0, 1))}
    grads["out"] = both.reshape(-1, 2 * size).T @ d_scores.reshape(-1, TAGS)
    return float((z - gold).sum() / n), grads


@lru_cache(maxsize=2)
def train(windows: int = 6000, epochs: int = 5, batch: int = 64, seed: int = 7) -> dict:
    """The model's arrays, fitted to ``windows`` labelled windows by Adam."""
    import numpy as np

    rng = np.random.default_rng(seed)
    data = list(labelled(windows, seed))
    ids = np.array([classes(t) for t, _ in data])
    tags = np.array([tags_of(TRAINED, s) for _, s in data])
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    model = {"embed": draw(CLASSES, INPUT) * 2, "out": draw(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
    for k in "fb":
        model |= {f"w{k}": draw(INPUT, 4 * HIDDEN), f"u{k}": draw(HIDDEN, 4 * HIDDEN), f"b{k}": np.zeros(4 * HIDDEN, np.float32)}
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    step, steps = 0, epochs * (windows // batch)
    for _ in range(epochs):
        order = rng.permutation(windows)
        for i in range(0, windows - batch + 1, batch):
            step += 1
            rate = 0.02 * (1 - step / (steps + 1))
            _, grads = _gradients(model, ids[order[i : i + batch]], tags[order[i : i + batch]])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / norm)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model[k] = (model[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    # Only a beginning or an inside of its kind goes before an inside.
    for k in range(len(KINDS)):
        for a in range(TAGS):
            if a not in (1 + 2 * k, 2 + 2 * k):
                model["trans"][a, 2 + 2 * k] = -1e4
    return model


def decode(model: dict, ids):
    """The best tags (batch, time) of class ids."""
    import numpy as np

    scores = emissions(model, ids)
    time, batch = scores.shape[:2]
    best, back = scores[0].copy(), np.empty((time, batch, TAGS), np.int8)
    for t in range(1, time):
        paths = best[:, :, None] + model["trans"][None]
        back[t] = paths.argmax(1)
        best = scores[t] + np.take_along_axis(paths, back[t][:, None, :].astype(np.int64), 1)[:, 0]
    tags = np.empty((time, batch), np.int8)
    tags[-1] = best.argmax(1)
    for t in range(time - 1, 0, -1):
        tags[t - 1] = np.take_along_axis(back[t], tags[t][:, None].astype(np.int64), 1)[:, 0]
    return tags.T


def windows_of(text: str, every: bool = False) -> list[int]:
    """Starts of the windows to decode: those that hold a digit or an @ sign and those beside them, or ``every`` one."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    if every:
        return [k * STRIDE for k in range(last + 1)]
    wanted: set[int] = set()
    for m in _TRIGGER.finditer(text):
        k = m.start() // STRIDE
        wanted.update((k - 2, k - 1, k, k + 1))
    return [k * STRIDE for k in sorted(wanted) if 0 <= k <= last]


def _owned(start: int, length: int) -> tuple[int, int]:
    """The places of a text that lie farther from the edges of the window at ``start`` than from those of any other."""
    return start and start + STRIDE // 2, length if start + WINDOW >= length else start + WINDOW - STRIDE // 2


def _spans_of(tags) -> list[tuple[str, int, int]]:
    """Spans of a text's tags; an inside that follows nothing of its kind begins a span."""
    import numpy as np

    kind = (tags + 1) // 2
    edge = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | ((tags[1:] % 2 == 1) & (tags[1:] > 0)), [True]]))
    return [(KINDS[kind[a] - 1], int(a), int(b)) for a, b in zip(edge, edge[1:]) if kind[a]]


#: Windows that are decoded at once.
BATCH = 512


def model_spans(model: dict, texts: list[str], every: bool = False) -> list[list[tuple[str, int, int]]]:
    """The model's spans of each text, over all its windows."""
    import numpy as np

    jobs = [(i, s) for i, t in enumerate(texts) for s in windows_of(t, every)]
    tags = {i: np.zeros(len(texts[i]), np.int8) for i in {i for i, _ in jobs}}
    coded = {i: classes(texts[i]) for i in tags}
    for at in range(0, len(jobs), BATCH):
        part = jobs[at : at + BATCH]
        ids = np.full((len(part), WINDOW), OWN.index("\n"), np.int8)
        for row, (i, s) in zip(ids, part):
            own = coded[i][s : s + WINDOW]
            row[: len(own)] = own
        for (i, s), row in zip(part, decode(model, ids)):
            a, b = _owned(s, len(texts[i]))
            tags[i][a:b] = row[a - s : b - s]
    return [_spans_of(tags[i]) if i in tags else [] for i in range(len(texts))]


_EDGES = " \t\n\r\"',;:!?*#$&|<>=."


def holds(kind: str, s: str) -> bool:
    """Whether a span of the model holds what its kind must hold."""
    numbers = re.findall("[0-9]+", s)
    if kind == "email":
        return s.count("@") == 1 and "." in s.split("@")[1].strip(_EDGES)
    if kind == "ip":
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    return passes(kind, s)


def spans(model: dict, texts: list[str], every: bool = False) -> list[tuple[list, list]]:
    """(base, all) spans of each text, by kind as listed and then start."""
    out = []
    for text, added in zip(texts, model_spans(model, texts, every)):
        base = base_spans(text)
        found = list(base)
        if added:
            taken = bytearray(len(text))
            for _, a, b in base:
                taken[a:b] = b"\1" * (b - a)
            for kind, a, b in added:
                a, b = a + len(text[a:b]) - len(text[a:b].lstrip(_EDGES)), b - len(text[a:b]) + len(text[a:b].rstrip(_EDGES))
                if a < b and holds(kind, text[a:b]) and not any(taken[a:b]):
                    found.append((kind, a, b))
        out.append((base, sorted(found, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))))
    return out


def rendered(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find_pii(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, base, spans) for every row: spans as kind:start:end, comma-joined, and the counts of base spans by kind."""
    sent = docs.sparkSession.sparkContext.broadcast(model or train())

    def find(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            found = spans(sent.value, texts)
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array([rendered(b) for b, _ in found], pa.string()), pa.array([rendered(a) for _, a in found], pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")
