"""Secret scanning: fixed patterns, and a linear-chain conditional random field.

The patterns (assignments, access keys, long hexadecimal runs) give the base
spans. The field tags each token as begin, inside or outside of a secret from
its shape, the words and signs beside it and features of the file, with weights
fitted by maximum likelihood on generated lines, and is decoded by Viterbi; the
spans it adds are of kind ``crf``, where no base span lies. What the patterns
miss and it is fitted for: codes by their shape, values behind other words than
the patterns', passwords in connection strings (scheme://user:password@host), and
the lines of PEM blocks that hold private keys.

Every token may begin a secret, and one glued to the token before it may
continue one; the weights alone decide. All tokens are scored, with array
lookups by token. A token is left out of the search only if no tags that begin
there can gain on those outside, whatever stands around them (see
``Scorer.__init__``), so the result is that of Viterbi over the whole text.

Defined results: null and empty texts have no spans; offsets are code points,
the end exclusive; very long texts are scanned whole; rows are judged one by
one, so repeated or null ids and other columns make no difference; an empty
table gives no row.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
TOKEN = re.compile(r"[\w+/-]+|[^\s\w+/-]")
CHUNKS = re.compile(r"\S+")
WORD = re.compile(r"[A-Za-z]{2,}")
#: Tokens of a PEM body have so many characters or more.
PEM_LINE = 16
OUT, BEGIN, INSIDE = 0, 1, 2
STARTS = (0.0, 0.0, -math.inf)
#: Words after which shapes weigh differently.
LEADS = frozenset("password passwd pwd pass passphrase secret token apikey key auth credential credentials bearer".split())
#: Chunks that a task keeps scores of before it starts anew.
CACHED = 200_000


def base_spans(text: str, may_hex: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches, each kind leftmost without overlap."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if may_hex:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def can_begin(token: str) -> bool:
    """Whether a token looks like a code by itself; the file's features count those."""
    return len(token) >= 20 or (len(token) >= 8 and any(c in string.digits for c in token))


def shape(token: str) -> str:
    kinds = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "-" for c in token)
    return re.sub(r"(.)\1+", r"\1", kinds)[:6]


def own_features(t: str) -> list[str]:
    """Names of what holds of a token by itself."""
    n, digits = len(t), sum(c.isdigit() for c in t)
    upper, lower = sum(c.isupper() for c in t), sum(c.islower() for c in t)
    return ["bias", f"shape={shape(t)}", f"len={min(n // 4, 12)}", f"digits={10 * digits // n}", f"mixed={digits > 0}{upper > 0}{lower > 0}", f"kinds={10 * len(set(t)) // n}", f"turns={min(9, sum((a.isdigit(), a.isupper()) != (b.isdigit(), b.isupper()) for a, b in zip(t, t[1:], strict=False)) * 10 // n)}", f"lead={t[:3] if n >= 16 else ''}", f"hex={all(c in '0123456789abcdefABCDEF-' for c in t)}", f"dashes={min(4, t.count('-'))}", f"slashes={min(3, t.count('/'))}", f"core={can_begin(t)}", f"plain={t.islower() and t.isalpha()}", f"sign={'' if any(c.isalnum() for c in t) else t[:1]}"]


def led_features(t: str) -> list[str]:
    """Names of what holds besides of a token after one of LEADS."""
    return ["led", f"led:shape={shape(t)}", f"led:len={min(len(t) // 4, 12)}", f"led:plain={t.islower() and t.isalpha()}"]


def is_word(token: str) -> bool:
    return WORD.fullmatch(token) is not None


def features(tokens: list[str], glued: list[bool], k: int, file: tuple[str, ...]) -> list[str]:
    """Names of what holds of token k."""
    before = [w.lower() for w in tokens[max(0, k - 4) : k] if is_word(w)][-2:]
    out = own_features(tokens[k]) + (led_features(tokens[k]) if LEADS.intersection(before) else []) + [f"glued={glued[k]}"]
    out += [f"before={w}" for w in before]
    if k + 1 < len(tokens) and told_after(tokens[k + 1]):
        out.append(f"after={tokens[k + 1].lower()}")
    if k > 1 and tokens[k - 2].startswith("//"):
        out.append("authority")
    out.append(f"mark={tokens[k - 1] if k and not tokens[k - 1].isalnum() else ''}")
    return out + list(file) + pem_features(file, len(tokens[k]) >= PEM_LINE)


def told_after(token: str) -> bool:
    """Whether a token tells something of the one before it: words, and the sign that ends the password of a connection string."""
    return token == "@" or is_word(token)


def pem_features(file: tuple[str, ...], long: bool) -> list[str]:
    """What a block of the file tells of a long token."""
    return [f"long:{f}" for f in file if long and f.startswith("file:pem")]


def file_features(n_chunks: int, n_core: int, text: str) -> tuple[str, ...]:
    """Of the numbers of chunks and of those with a token that looks like a code, and of the text."""
    block = "-----BEGIN" in text
    pem = ("private" if "PRIVATE KEY-----" in text else "public") if block else "none"
    return (f"file:pem={pem}", f"file:core={min(5, int(math.log2(1 + n_core)))}", f"file:dense={10 * n_core >= n_chunks}", f"file:equals={'=' in text}", f"file:key={'key' in text.lower()}", f"file:url={'://' in text}")


def file_of(text: str) -> tuple[str, ...]:
    chunks = text.split()
    return file_features(len(chunks), sum(any(map(can_begin, TOKEN.findall(c))) for c in chunks), text)


def states(tokens: list[str], glued: list[bool]) -> list[tuple[int, ...]]:
    """The tags that each token may have."""
    return [(OUT, BEGIN, *((INSIDE,) if g and k else ())) for k, g in enumerate(glued)]


class Crf:
    def __init__(self, weights: dict[str, list[float]], moves: list[list[float]]):
        self.weights, self.moves = weights, moves

    def emissions(self, rows: list[list[str]]) -> list[list[float]]:
        zero, get = [0.0, 0.0, 0.0], self.weights.get
        return [[sum(x) for x in zip(*(get(f, zero) for f in row), strict=True)] for row in rows]

    def viterbi(self, emit: list[list[float]], may: list[tuple[int, ...]]) -> list[int]:
        score, back = {s: emit[0][s] + STARTS[s] for s in may[0]}, []
        for e, allowed in zip(emit[1:], may[1:], strict=True):
            new, step = {}, {}
            for s in allowed:
                step[s] = best = max(score, key=lambda r: (score[r] + self.moves[r][s], -r))
                new[s] = score[best] + self.moves[best][s] + e[s]
            score = new
            back.append(step)
        tags = [max(score, key=lambda r: (score[r], -r))]
        for step in reversed(back):
            tags.append(step[tags[-1]])
        return tags[::-1]

    def _sums(self, emit, may, moves):
        """Log sums over all tag rows from the left, by token and tag."""
        rows = [{s: emit[0][s] + STARTS[s] for s in may[0]}]
        for e, allowed in zip(emit[1:], may[1:], strict=True):
            last, new = rows[-1], {}
            for s in allowed:
                terms = [v + moves[r][s] for r, v in last.items()]
                top = max(terms)
                new[s] = e[s] + (top + math.log(sum(math.exp(x - top) for x in terms)) if top > -math.inf else -math.inf)
            rows.append(new)
        return rows

    def learn(self, rows: list[list[str]], may, gold: list[int], rate: float) -> None:
        """One ascent step on the log likelihood of the gold tags."""
        emit = self.emissions(rows)
        left = self._sums(emit, may, self.moves)
        right: list[dict[int, float]] = [{s: 0.0 for s in may[-1]}]
        for k in range(len(rows) - 1, 0, -1):
            new = {}
            for r in may[k - 1]:
                terms = [self.moves[r][s] + emit[k][s] + v for s, v in right[0].items()]
                top = max(terms)
                new[r] = top + math.log(sum(math.exp(x - top) for x in terms)) if top > -math.inf else -math.inf
            right.insert(0, new)
        top = max(left[-1].values())
        total = top + math.log(sum(math.exp(v - top) for v in left[-1].values()))
        for k, row in enumerate(rows):
            slope = [0.0, 0.0, 0.0]
            slope[gold[k]] += 1.0
            for s in may[k]:
                slope[s] -= math.exp(left[k][s] + right[k][s] - total)
            for f in row:
                w = self.weights.setdefault(f, [0.0, 0.0, 0.0])
                for s in (0, 1, 2):
                    w[s] += rate * slope[s]
        grad = [[0.0] * 3 for _ in range(3)]
        for k in range(1, len(rows)):
            grad[gold[k - 1]][gold[k]] += 1.0
            for r, v in left[k - 1].items():
                for s, x in right[k].items():
                    if (p := v + self.moves[r][s] + emit[k][s] + x - total) > -50:
                        grad[r][s] -= math.exp(p)
        for r in range(3):
            for s in range(3):
                if self.moves[r][s] > -math.inf:
                    self.moves[r][s] += rate * grad[r][s]


def split_tokens(text: str) -> tuple[list[str], list[bool], list[tuple[int, int]]]:
    found = list(TOKEN.finditer(text))
    spots = [m.span() for m in found]
    return [m[0] for m in found], [k > 0 and spots[k - 1][1] == spots[k][0] for k in range(len(spots))], spots


def generated_lines(n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Invented lines with the spans of the secrets in them."""
    rnd = random.Random(seed)
    pick = lambda alphabet, k: "".join(rnd.choice(alphabet) for _ in range(k))
    digits, low, word = string.digits, string.ascii_lowercase, string.ascii_letters + string.digits
    syllables = ("th", "en", "ou", "er", "la", "de", "ti", "on", "sch", "ra", "ez", "que")
    prose = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 5)))
    secrets = (
        lambda: pick(word, rnd.randint(20, 48)), lambda: "sk_" + rnd.choice(("live", "test")) + "_" + pick(word, 24), lambda: "ghp_" + pick(word, 36),
        lambda: "xoxb-" + pick(digits, 11) + "-" + pick(word, 24), lambda: pick(word + "+/", 40), lambda: "eyJ" + pick(word, 20) + "." + pick(word, 40) + "." + pick(word + "_-", 30),
        lambda: pick(word, rnd.randint(10, 18)), lambda: "AIza" + pick(word + "_-", 35), lambda: "AKIA" + pick(string.ascii_uppercase + digits, 16),
    )
    plain = (
        lambda: "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), lambda: "-".join((pick(digits, 4), pick(digits, 2), pick(digits, 2))), lambda: "+" + pick(digits, rnd.randint(8, 13)),
        lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4)), lambda: prose() + pick(digits, 2) + "@" + prose() + ".example.org", lambda: "https://www." + prose() + ".net/" + prose() + "/" + pick(digits, 5),
        lambda: pick(digits, rnd.randint(8, 16)), lambda: prose() + prose() + prose() + prose() + prose() + prose(), lambda: prose() + "_" + prose() + "_v" + pick(digits, 2), lambda: "-".join(pick(digits, 4) for _ in range(4)),
        lambda: "/usr/" + prose() + "/" + prose() + pick(digits, 3), lambda: low[:1] + pick(digits, 9), lambda: prose().title() + pick(digits, 4) + prose(), lambda: "978-" + pick(digits, 10),
    )
    lines = []
    for _ in range(n):
        text, spans = " ".join(prose() for _ in range(rnd.randint(0, 5))), []
        for _ in range(rnd.randint(1, 3)):
            if secret := rnd.random() < 0.45:
                kind = rnd.randrange(len(secrets))
                value = secrets[kind]()
                named = kind == 6 or rnd.random() < 0.6
                lead = rnd.choice(("key", "token", "auth", "credential", "bearer", "secret", "pass", "private key", "access key", "pwd")) if named else prose()
                text += f" {lead}{rnd.choice((' ', '=', ': ', ' = ', ':')) if named else ' '}{rnd.choice(('', chr(34))) if named else ''}"
            else:
                value = rnd.choice(plain)()
                text += f" {rnd.choice((prose(), prose(), 'id', 'call', 'mail', 'on', 'version', 'order', 'key', 'see'))}{rnd.choice((' ', ' ', ': ', '='))}"
            if secret:
                spans.append((len(text), len(text) + len(value)))
            text += value + " " + " ".join(prose() for _ in range(rnd.randint(0, 4)))
        lines.append((text, spans))
    return lines


def harder_lines(n: int, seed: int = 8) -> list[tuple[str, list[tuple[int, int]]]]:
    """Invented lines with secrets of short pieces or of letters alone, and lines in which the same lead words have none."""
    rnd = random.Random(seed)
    word = string.ascii_letters + string.digits
    syllables = ("th", "en", "ou", "er", "la", "de", "ti", "on", "sch", "ra", "ez", "que", "sun", "flo", "win", "ter", "field", "\u00e9t", "\u00fcb")
    prose = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 5)))
    ascii_prose = lambda: "".join(rnd.choice(syllables[:17]) for _ in range(rnd.randint(2, 3)))
    piece = lambda: "".join(rnd.choice(word) for _ in range(rnd.randint(1, 5)))

    def pieces() -> str:
        out = piece()
        while len(out) < rnd.randint(8, 16) or out.isalnum():
            out += rnd.choice("!@#$%^&*?~-_") + piece()
        return out

    def letters() -> str:
        out = ""
        while len(out) < 8:
            out += rnd.choice((lambda: rnd.choice(string.ascii_uppercase) + "".join(rnd.choice(string.ascii_lowercase) for _ in range(2)), lambda: ascii_prose().title(), lambda: "".join(rnd.choice(string.ascii_letters) for _ in range(4))))()
        return out[:19]

    def filler(k: int) -> str:
        out = []
        for _ in range(k):
            w = prose()
            out.append((w.title() if rnd.random() < 0.2 else w) + rnd.choice(("",) * 8 + (",", ".", ";", "!", ")")))
        return " ".join(out)

    plain = (
        prose, lambda: prose() + ".", lambda: prose() + "." + prose(), lambda: prose() + "()", lambda: prose() + "_" + prose(), lambda: prose() + "'s " + prose(), lambda: rnd.choice(("true", "None", "false", "null", "required", "value")),
        lambda: str(rnd.randint(0, 9999)), lambda: prose().title() + " " + prose().title(), lambda: prose() + "-" + prose(), lambda: '"' + prose() + '"', lambda: prose() + "/" + prose() + "?", lambda: "<" + prose() + ">",
    )
    lines = []
    for _ in range(n):
        text, spans = filler(rnd.choice((0, 2, 5, 30))), []
        for _ in range(rnd.randint(1, 2)):
            lead = rnd.choice(sorted(LEADS))
            if rnd.random() < 0.55:
                text += f" {lead}{rnd.choice((': ', '=', ' = ', ':', ' ')) if lead != 'bearer' else ' '}{rnd.choice(('', '', chr(34)))}"
                value = rnd.choice((pieces, letters))()
                spans.append((len(text), len(text) + len(value)))
                text += value + (rnd.choice((chr(34), chr(34) + ",")) if text.endswith(chr(34)) else "")
            elif rnd.random() < 0.6:
                text += f" {lead}{rnd.choice((' ', ' ', ': ', ' = ', '='))}{rnd.choice(plain)()}"
            else:
                text += f" {prose()}{rnd.choice((' ', ': ', ' = ', '='))}{rnd.choice((*plain, lambda: prose().title() + prose().title(), lambda: prose() + '@' + prose() + '.org'))()}"
            text += " " + filler(rnd.choice((0, 1, 4)))
        lines.append((text, spans))
    return lines


def placed_lines(n: int, seed: int = 9) -> list[tuple[str, list[tuple[int, int]]]]:
    """Invented texts whose secrets are told by their place: passwords of connection strings and lines of private keys; and the like without any."""
    rnd = random.Random(seed)
    pick = lambda alphabet, k: "".join(rnd.choice(alphabet) for _ in range(k))
    low, word = string.ascii_lowercase, string.ascii_letters + string.digits
    syllables = ("th", "en", "ou", "er", "la", "de", "ti", "on", "ra", "que", "sun", "win", "ter", "mar", "db", "app")
    name = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3)))
    host = lambda: rnd.choice((lambda: name(), lambda: f"{name()}.{name()}.{rnd.choice(('org', 'net', 'internal', 'com'))}", lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4)), lambda: f"{name()}-{name()}.{name()}.com"))() + rnd.choice(("", "", f":{rnd.randint(80, 65000)}"))
    path = lambda: "".join("/" + rnd.choice((name, lambda: pick(word, 5), lambda: str(rnd.randint(0, 9999))))() for _ in range(rnd.randint(0, 3))) + rnd.choice(("", "", "?" + name() + "=" + name(), ".html"))
    user = lambda: rnd.choice((name, name, lambda: name() + "_" + name(), lambda: name() + "-" + name(), lambda: name() + str(rnd.randint(0, 99)), lambda: ""))()
    values = (
        lambda: pick(word, rnd.randint(6, 24)), lambda: name() + str(rnd.randint(0, 9999)), lambda: name().title() + name().title() + str(rnd.randint(0, 99)), lambda: name() + name(), lambda: pick(low, rnd.randint(5, 12)), lambda: pick(word, 4) + "%40" + pick(word, 4),
    )
    schemes = ("postgres", "postgresql", "mysql", "redis", "rediss", "amqp", "mongodb", "mongodb+srv", "http", "https", "ftp", "sftp", "ssh", "smtp", "ldap", "jdbc:mysql")
    prose = lambda k: " ".join(name() for _ in range(rnd.randint(0, k)))
    clear = (
        lambda: f"{rnd.choice(schemes)}://{host()}{path()}", lambda: f"{rnd.choice(schemes)}://{user() or 'git'}@{host()}{path()}", lambda: f"mailto:{name()}@{host()}", lambda: f"git@{host()}:{name()}{path()}",
        lambda: f"{name()}@{name()}.org", lambda: f"{name()}: {name()}@{name()}.net", lambda: f"@{name()}", lambda: f"{rnd.randint(1, 12)}:{rnd.randint(10, 59)} @ {name()}", lambda: f"{name()}:{name()}", lambda: f"{name()}:{rnd.randint(1, 9999)}/{name()}",
        lambda: f"//{name()}.js:{rnd.randint(1, 999)}:{rnd.randint(1, 99)}", lambda: f"{name()}@{rnd.randint(0, 9)}.{rnd.randint(0, 20)}.{rnd.randint(0, 20)}", lambda: f"// {name()}: {name()}",
        lambda: rnd.choice(("*", "**", "_", "`")).join(("", name(), "")),
    )
    cases = (str, str.title, str.upper)
    marked = lambda case: " ".join((case or rnd.choice(cases))(name()) + rnd.choice(("", "", "", ".", ",", "." + (case or str)(name()), "," + (case or str)(name()))) + rnd.choice("*$%&#|<>!?~^") * rnd.randint(0, 4) for _ in range(rnd.randint(1, 12)))
    lines = []
    for _ in range(n):
        text, spans = prose(6), []
        if rnd.random() < 0.4:
            lines.append((marked(rnd.choice((None, *cases))), spans))
            continue
        if rnd.random() < 0.25:
            private, kind = rnd.random() < 0.6, rnd.choice(("RSA ", "EC ", "", "OPENSSH ", "DSA ", "ENCRYPTED "))
            title = f"{kind}PRIVATE KEY" if private else rnd.choice(("CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY", "CERTIFICATE REQUEST", "PGP SIGNATURE"))
            width, text = rnd.choice((48, 64, 64, 76)), text + f"\n-----BEGIN {title}-----\n"
            for k in range(rows := rnd.randint(1, 5)):
                line = pick(word + "+/", width if k + 1 < rows else rnd.randint(20, width)) + ("" if k + 1 < rows else rnd.choice(("", "=", "==")))
                if private:
                    spans.append((len(text), len(text) + len(line)))
                text += line + "\n"
            lines.append((text + f"-----END {title}-----\n{prose(6)}", spans))
            continue
        for _ in range(rnd.randint(1, 3)):
            text += " " + rnd.choice(("", "", name() + "=", name().upper() + "_URL=", "url: ", '"'))
            if rnd.random() < 0.5:
                value, basic = rnd.choice(values)(), rnd.random()
                if basic < 0.1:
                    head, value, tail = "Authorization: Basic ", pick(word, rnd.randint(12, 30)) + rnd.choice(("", "=", "==")), ""
                else:
                    head, tail = f"{rnd.choice(schemes)}://{user()}:", f"@{host()}{path()}"
                text += head
                spans.append((len(text), len(text) + len(value)))
                text += value + tail
            else:
                text += rnd.choice(clear)()
            text += " " + prose(5)
        lines.append((text, spans))
    return lines


@lru_cache(maxsize=1)
def trained(lines: int = 2000, placed: int = 1200, rounds: int = 5) -> Crf:
    crf = Crf({}, [[0.0, 0.0, -math.inf], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
    samples, names = [], {}  # one string for each name, as the samples hold millions and the weights keep a few
    for text, spans in generated_lines(lines) + harder_lines(lines) + placed_lines(placed):
        tokens, glued, spots = split_tokens(text)
        may, gold, file = states(tokens, glued), [OUT] * len(tokens), file_of(text)
        for a, b in spans:
            inside = [k for k, (i, j) in enumerate(spots) if a <= i and j <= b]
            for k in inside:
                gold[k] = INSIDE if k > inside[0] else BEGIN
        samples.append(([[names.setdefault(f, f) for f in features(tokens, glued, k, file)] for k in range(len(tokens))], may, gold))
    rnd = random.Random(11)
    for k in range(rounds):
        rnd.shuffle(samples)
        for rows, may, gold in samples:
            crf.learn(rows, may, gold, 0.1 / (1 + k))
    del samples, rows, may, gold
    common.release()
    return crf


class Scorer(dict):
    """Scores all tokens of texts by tables of the chunks seen so far: their numbers by chunk."""

    def __init__(self, crf: Crf):
        super().__init__()
        self.crf, m = crf, crf.moves
        #: Putting OUT for the tags of one secret, with r before, s after and x its last tag, changes the moves by
        #: no more than these, one for its BEGIN and one for each INSIDE; a path that gains by it is not the best.
        self.begin = max(0.0, *(m[r][BEGIN] - m[r][OUT] for r in range(3))) + max(0.0, *(m[x][s] - m[OUT][s] for x in (BEGIN, INSIDE) for s in (OUT, BEGIN)))
        self.inside = max(m[x][INSIDE] for x in (BEGIN, INSIDE)) - m[OUT][OUT]
        self.lead_of = {f: (b - o, i - o) for f, (o, b, i) in crf.weights.items()}
        self.glued, self.loose = self._gain(["glued=True"]), self._gain(["glued=False"])
        self.authority = self._gain(["authority"])
        self.no_mark = np.array(self._gain(["mark="]))
        self.words: dict[str, int] = {}
        self.shapes: dict[tuple, list[float]] = {}
        self._clear()

    def _clear(self) -> None:
        self.clear()
        self.words.clear()
        self.table, self.flags = np.zeros((1024, 12)), np.zeros((1024, 3), bool)
        self.first, self.count, self.core, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, bool), np.zeros(1024, np.int64), 0

    def _gain(self, names: list[str]) -> list[float]:
        """What BEGIN and INSIDE have over OUT."""
        get, begin, inside = self.lead_of.get, 0.0, 0.0
        for name in names:
            if w := get(name):
                begin, inside = begin + w[0], inside + w[1]
        return [begin, inside]

    def _own(self, t: str) -> list[float]:
        n = len(t)
        if n < 16 and t.isalpha() and (t.islower() or (t[0].isupper() and t[1:].islower())):  # these features tell only so much of a plain word
            name = (n, len(set(t)), t.islower(), not t.strip("abcdefABCDEF"))
            if name not in self.shapes:
                own = own_features(t)
                self.shapes[name] = self._gain(own) + self._gain(own + led_features(t))
            return self.shapes[name]
        own = own_features(t)
        return self._gain(own) + self._gain(own + led_features(t))

    def _word(self, t: str) -> int:
        k = self.words.get(t)
        if k is None:
            k = self.words[t] = len(self.words)
            if k == len(self.table):
                self.table, self.flags = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.flags, np.zeros_like(self.flags)])
            get, none, low = self.lead_of.get, (0.0, 0.0), t.lower()
            word = is_word(t)
            before, after = get(f"before={low}", none) if word else none, get(f"after={low}", none) if told_after(t) else none
            self.table[k] = (*self._own(t), *before, *after, *get("mark=" if t.isalnum() else f"mark={t}", none), *(self.authority if t.startswith("//") else none))
            self.flags[k] = word, word and low in LEADS, len(t) >= PEM_LINE
        return k

    def __missing__(self, chunk: str) -> int:
        tokens, k = TOKEN.findall(chunk), len(self)
        if k == len(self.first):
            self.first, self.count, self.core = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count, self.core))
        while self.used + len(tokens) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.first[k], self.count[k], self.core[k] = self.used, len(tokens), len(chunk) >= 8 and any(map(can_begin, tokens))
        for j, t in enumerate(tokens, self.used):
            self.flat[j] = self._word(t)
        self.used += len(tokens)
        self[chunk] = k
        return k

    def gains(self, text: str):
        """By token what BEGIN and INSIDE have over OUT and whether it is glued to the one before; the first token of each chunk."""
        if len(self) > CACHED:
            self._clear()
        chunks = text.split()
        ids = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        n = self.count[ids]
        starts = np.cumsum(n) - n
        tokens = self.flat[np.repeat(self.first[ids] - starts, n) + np.arange(int(n.sum()))]
        glued = np.ones(len(tokens), bool)
        glued[starts] = False
        x, (word, lead, long) = self.table[tokens], self.flags[tokens].T
        file = file_features(len(chunks), int(self.core[ids].sum()), text)
        out = np.where(glued[:, None], self.glued, self.loose) + self._gain(list(file))
        out[long] += self._gain(pem_features(file, True))
        seen, led = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        for back in range(1, min(5, len(tokens))):
            use = word[:-back] & (seen[back:] < 2)
            out[back:] += x[:-back, 4:6] * use[:, None]
            led[back:] |= use & lead[:-back]
            seen[back:] += use
        out += np.where(led[:, None], x[:, 2:4], x[:, 0:2])
        out[:-1] += x[1:, 6:8]
        out[1:] += x[:-1, 8:10]
        out[2:] += x[:-2, 10:12]
        out[0] += self.no_mark
        return out, glued, starts


def crf_spans(text: str, crf: Crf | Scorer) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the secrets that the field tags."""
    scorer = crf if isinstance(crf, Scorer) else Scorer(crf)
    if not text or text.isspace():
        return []
    gain, glued, starts = scorer.gains(text)
    more = np.cumsum(np.where(glued, np.maximum(0.0, gain[:, 1] + scorer.inside), 0.0))
    ends = np.append(starts[1:], len(gain))
    rest = np.repeat(more[ends - 1], ends - starts) - more  # at most what the chunk's later tokens add
    may_begin = gain[:, 0] + scorer.begin + rest >= -1e-6
    live = np.flatnonzero(np.logical_or.reduceat(may_begin, starts))
    if not len(live):
        return []
    spots, found = [m.span() for m in CHUNKS.finditer(text)], []
    for run in np.split(live, np.flatnonzero(np.diff(live) > 1) + 1):
        a, b = int(starts[run[0]]), int(ends[run[-1]])
        emit = [[0.0, x, y] for x, y in gain[a:b].tolist()]
        may = [(OUT, *((BEGIN,) if p else ()), *((INSIDE,) if g else ())) for p, g in zip(may_begin[a:b].tolist(), glued[a:b].tolist(), strict=True)]
        before, after = int(a > 0), int(b < len(gain))  # neighbours that are surely outside
        tags = scorer.crf.viterbi([[0.0] * 3] * before + emit + [[0.0] * 3] * after, [(OUT,)] * before + may + [(OUT,)] * after)[before:]
        if not any(tags):
            continue
        where = [(spots[c][0] + m.start(), spots[c][0] + m.end()) for c in run for m in TOKEN.finditer(text[slice(*spots[c])])]
        i = 0
        while i < b - a:
            if tags[i] == BEGIN:
                j = i
                while j + 1 < b - a and tags[j + 1] == INSIDE:
                    j += 1
                found.append((where[i][0], 3, where[j][1]))
                i = j
            i += 1
    return sorted(set(found))


def all_spans(text: str, crf: Scorer, may_hex: bool) -> tuple[list, list]:
    """Base spans, and all spans: those of the field are added where no base span lies."""
    base = base_spans(text, may_hex)
    more = crf_spans(text, crf)
    if base and more:
        more = [s for s in more if not any(s[0] < e and b < s[2] for b, _, e in base)]
    return base, sorted(base + more)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def _flags(texts: pa.Array) -> np.ndarray:
    """By row, whether it may hold a long hexadecimal run."""
    data, offsets = common.texts_of(texts)
    n = len(offsets) - 1

    def has_run(stops: np.ndarray, least: int) -> np.ndarray:
        """Rows that a run without stops touches; a run over the end of a row touches both."""
        edges = np.concatenate([[-1], np.flatnonzero(stops), [len(data)]])
        long = np.flatnonzero(np.diff(edges) > least)
        touched = np.zeros(n + 1, np.int64)
        np.add.at(touched, np.searchsorted(offsets, edges[long] + 1, "right") - 1, 1)
        np.add.at(touched, np.searchsorted(offsets, edges[long + 1] - 1, "right"), -1)
        return np.cumsum(touched[:n]) > 0

    if not len(data):
        return np.zeros(n, bool)
    return has_run(~_HEX[data], LEAST_HEX)


def scan(docs: DataFrame, crf: Crf, text: str = "text") -> DataFrame:
    """doc_id, the numbers of base spans, base_sha256 and spans of each whole text."""
    spark = docs.sparkSession
    common.tune(spark)
    shared = spark.sparkContext.broadcast(crf)

    def run(batches):
        model = Scorer(shared.value)
        for b in batches:
            may_hex = _flags(b.column(1))
            counts, hashes, spans = [[], [], []], [], []
            for t, h in zip(b.column(1).to_pylist(), may_hex, strict=True):
                base, every = all_spans(t, model, h) if t else ([], [])
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                hashes.append(hashlib.sha256(spelled(base).encode()).hexdigest())
                spans.append(spelled(every))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return docs.select("doc_id", text).mapInArrow(common.trimmed(run), schema)


def redact(docs: DataFrame, crf: Crf, text: str = "text", filler: str = "[secret]") -> DataFrame:
    """docs with each span of a secret replaced in the text; overlapping spans become one."""
    spark = docs.sparkSession
    common.tune(spark)
    shared = spark.sparkContext.broadcast(crf)

    def clean(t: str, h: bool, model: Scorer) -> str:
        out, last = [], 0
        for a, _, b in all_spans(t, model, h)[1]:
            if a >= last:
                out += [t[last:a], filler]
            last = max(last, b)
        return "".join([*out, t[last:]]) if out else t

    def run(batches):
        model = Scorer(shared.value)
        for b in batches:
            at = b.schema.get_field_index(text)
            new = pa.array([clean(t, h, model) if t else t for t, h in zip(b.column(at).to_pylist(), _flags(b.column(at)), strict=True)], pa.string())
            yield b.set_column(at, b.schema.field(at), new.cast(b.column(at).type))

    return docs.mapInArrow(common.trimmed(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.read_table(spark, sf_dir, "documents"), trained())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; secrets are replaced by a filler, and n_chars follows the text."""
    out = redact(docs, trained())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
