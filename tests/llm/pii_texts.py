"""Personal data in running text, made apart from what the model is trained on: other words, names, hosts and frames."""

import random

WORDS = "we met near the station after lunch and the clerk said that nothing had been sent yet please ask again on monday maybe later this week wir haben gestern nichts mehr gehört la maison est grande y el tren sale pronto".split()
NAMES = "maria jones weber okafor tanaka silva dubois novak lindqvist rossi kim oconnor vanderberg papadopoulos".split()
HOSTS = "acme northwind contoso fabrikam globex initech umbrella hooli vandelay".split()
ENDS = ("com", "net", "org", "io", "fr", "co.uk", "com.br", "de", "gov.au")


def luhn_number(rng, size, lead):
    body = lead + "".join(str(rng.randrange(10)) for _ in range(size - len(lead) - 1))
    for last in "0123456789":
        total = 0
        for i, c in enumerate(reversed(body + last)):
            x = int(c) << (i & 1)
            total += x - 9 if x > 9 else x
        if total % 10 == 0:
            return body + last


def one(rng, kind, unusual):
    n = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))
    if kind == "email":
        who = rng.choice((rng.choice(NAMES), f"{rng.choice(NAMES)}.{rng.choice(NAMES)}", f"{rng.choice(NAMES)[0]}{rng.choice(NAMES)}{n(2)}", f"{rng.choice(NAMES)}+{rng.choice(WORDS[:9])}"))
        at = rng.choice((" @ ", "[@]", "(@)")) if unusual else "@"
        return f"{who}{at}{rng.choice(('', '', 'mx.'))}{rng.choice(HOSTS)}.{rng.choice(ENDS)}"
    if kind == "ip":
        sep = rng.choice(("[.]", "(.)", " . ")) if unusual else "."
        return sep.join(str(rng.choice((rng.randrange(256), rng.randrange(100, 256)))) for _ in range(4))
    if kind == "card":
        size, lead = rng.choice(((16, "4"), (16, "5"), (16, "6"), (15, "37")))
        x = luhn_number(rng, size, lead)
        sep = rng.choice((".", "/", "_", "  ")) if unusual else rng.choice(("", " ", "-"))
        cuts = (0, 4, 10, 15) if size == 15 else (0, 4, 8, 12, 16)
        return sep.join(x[a:b] for a, b in zip(cuts, cuts[1:]))
    if unusual:
        return rng.choice((f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"{n(3)}.{n(3)}.{n(4)}", f"00{n(2)} {n(2)} {n(3)} {n(4)}", f"0{n(2)}/{n(7)}"))
    return rng.choice((f"+1 ({n(3)}) {n(3)}-{n(4)}", f"+49 {n(3)} {n(7)}", f"+{n(11)}", f"+33 {n(1)} {n(2)} {n(2)} {n(2)} {n(2)}"))


def decoy(rng):
    n = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))
    return rng.choice((f"20{n(2)}-0{n(1)}-1{n(1)}", f"at 1{n(1)}:{n(2)}", f"room {n(3)}", f"{n(2)}%", f"${n(1)},{n(3)}.{n(2)}", f"version {n(1)}.{n(2)}.{n(1)}", f"pages {n(2)}-{n(3)}", f"ref {n(6)}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"({n(4)})", f"item #{n(4)}", f"{n(2)}.{n(2)}.20{n(2)}"))


def texts(count, seed, unusual):
    """``count`` texts of some hundred characters with their spans [(kind, start, end)]."""
    rng = random.Random(seed)
    for _ in range(count):
        text, spans = "", []
        for _ in range(rng.randint(3, 6)):
            text += " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 12))) + rng.choice((" ", ": ", ", "))
            if rng.random() < 0.6:
                kind = rng.choice(("email", "ip", "card", "phone"))
                piece = one(rng, kind, unusual)
                spans.append((kind, len(text), len(text) + len(piece)))
            else:
                piece = decoy(rng)
            text += piece + rng.choice((" ", ", ", ". ", "\n", "; "))
        yield text + rng.choice(WORDS), spans
