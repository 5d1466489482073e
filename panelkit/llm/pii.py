"""Personal data: fixed patterns, and a linear-chain CRF over word shapes that finds what the patterns miss.

Tokens are runs of characters that are not white space. A plain token (no digit and no at-sign, as a character or written
out in brackets) can only be outside of personal data, which splits a text exactly into short runs of other tokens; each
run, with a token on either side, is one sequence. Runs of whole batches are decoded together by Viterbi.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.crf import LinearChainCrf
from panelkit.llm.text import document_columns, per_batch

KINDS = ("email", "ip", "card", "phone")

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Each at-sign in turn, with the run of name characters before it: the leftmost match can begin nowhere else."""

    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        host = _HOST.match(text, at + 1) if begin < at else None
        if host:
            yield "email", begin, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by the fixed patterns, leftmost and non-overlapping per kind, by start and then kind."""

    if not _SIGN.search(text):
        return []
    out = list(_emails(text))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_HOT = re.compile(r"[0-9@]|[\[({](?i:at|dot)[\])}]")
_TOKEN = re.compile(r"\S+")
#: What may belong to a find at its ends.
_CORE = re.compile(r"[A-Za-z0-9+(\[{].*[A-Za-z0-9]", re.S)
_RUNS = (re.compile("[A-Z]+"), re.compile("[a-z]+"), re.compile("[0-9]+"))
# Words that announce a kind of personal data.
CUES = {
    "email": frozenset("email e-mail mail correo courriel contact kontakt write schreiben écrire escribir".split()),
    "ip": frozenset("ip host server address adresse dirección ping from via serveur servidor".split()),
    "card": frozenset("card visa mastercard amex kreditkarte carte tarjeta credit debit payment".split()),
    "phone": frozenset("phone tel telephone telefon téléphone teléfono call mobile cell fax whatsapp anrufen appelez llame rufnummer".split()),
}
#: Outside, and the first and later tokens of each kind.
LABELS = ("out", *(f"{p}-{k}" for k in KINDS for p in ("begin", "more")))
_FORBIDDEN = tuple((a, b) for b, name in enumerate(LABELS) if name.startswith("more") for a, other in enumerate(LABELS) if other.split("-")[-1] != name.split("-")[-1])


def shape(token: str) -> str:
    """Letter and digit runs by class; digit runs keep their length up to 4, other characters stay."""

    token = _RUNS[1].sub("a", _RUNS[0].sub("A", token[:64]))
    token = _RUNS[2].sub(lambda m: "9" * min(len(m.group()), 4) if len(m.group()) < 12 else "9L", token)
    return re.sub(r"[^\x00-\x7f]+", "u", token)[:24]


def token_features(tokens: list[str], k: int) -> list[str]:
    token = tokens[k]
    core = token.strip(".,;:!?\"'*#%&$|<>")
    digits = sum(map(str.isdigit, core))
    parts = re.findall(r"[0-9]+", core)
    found = [f"shape:{shape(core)}", f"digits:{min(digits, 20)}", f"groups:{min(len(parts), 6)}", f"sizes:{'-'.join(str(min(len(p), 9)) for p in parts[:6])}:{bool(re.search('[A-Za-z]', core))}"]
    found += [f"has:{c}" for c in "@+().-:/=\"" if c in core]
    if "@" in core:
        name, _, host = core.rpartition("@")
        found.append(f"mail:{bool(name)}:{'.' in host}:{bool(host) and host[-1:].isalpha()}")
    if parts and len(parts) == 4 and "." in core:
        found.append(f"quad:{all(int(p[:9]) <= 255 for p in parts)}")
    if 14 <= digits <= 19:
        found.append(f"luhn:{luhn(''.join(parts)) if ''.join(parts).isascii() else False}:{digits == len(re.sub('[.-]', '', core))}")
    if re.fullmatch(r"[\[({](?i:at|dot)[\])}]", core):
        found.append("spelled:" + core[1:-1].lower())
    if re.search(r"[\[({](?i:at)[\])}]", core):
        found.append("spelled-inside")
    for step, name in ((-2, "2before"), (-1, "before"), (1, "after")):
        near = tokens[k + step] if 0 <= k + step < len(tokens) else ""
        word = near.strip(".,;:!?\"'*#%&$|<>()=").lower()
        found += [f"{name}:{kind}" for kind, cues in CUES.items() if word in cues]
        if abs(step) == 1:
            found.append(f"{name}:{shape(near)[:8] if _HOT.search(near) else ('word' if near else 'none')}")
    return found


def _runs(text: str) -> Iterator[tuple[list[re.Match], int, int]]:
    """(tokens with two plain ones of context on either side, first hot, end of hot) for each run of tokens that aren't plain.

    One plain token may stand between hot ones of a run (as in a name written out).
    """

    at = 0
    while hot := _HOT.search(text, at):
        begin = hot.start()
        while begin > at and not text[begin - 1].isspace():
            begin -= 1
        before = _words_before(text, begin)
        tokens = [*before]
        first = len(tokens)
        place = begin
        end_hot = first
        while token := _TOKEN.search(text, place):
            tokens.append(token)
            place = token.end()
            if _HOT.search(token.group()):
                end_hot = len(tokens)
            elif len(tokens) - end_hot >= 2:
                break
        yield tokens, first, end_hot
        at = tokens[end_hot - 1].end()


def _words_before(text: str, begin: int) -> list[re.Match]:
    """The two tokens before begin, as far as they lie in the 80 characters before it."""

    window = max(0, begin - 80)
    return list(_TOKEN.finditer(text, window, begin))[-2:]


def sequences(text: str) -> tuple[list[list[str]], list[tuple[list[re.Match], int]]]:
    """Token texts of each run, and its matches with the number of the first token that can be labelled."""

    words, places = [], []
    for tokens, first, _ in _runs(text):
        words.append([t.group() for t in tokens])
        places.append((tokens, first))
    return words, places


def found_spans(tokens: list[re.Match], labels, first: int) -> list[Span]:
    out: list[Span] = []
    kind, begin, end = "", 0, 0

    def close() -> None:
        if kind:
            text = tokens[0].string
            core = _CORE.search(text, begin, end)
            if core:
                out.append((kind, core.start(), core.end()))

    for k, label in enumerate(labels):
        name = LABELS[label]
        if name == "out" or name.startswith("begin"):
            close()
            kind = ""
        if name != "out":
            if not kind:
                kind, begin = name.split("-")[1], tokens[k].start()
            end = tokens[k].end()
    close()
    return out


def all_spans(texts: list[str], model: LinearChainCrf) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text: what the field finds is added where it touches no base span."""

    base = [base_spans(t) for t in texts]
    words, places, owner = [], [], []
    for k, text in enumerate(texts):
        w, p = sequences(text)
        words += w
        places += p
        owner += [k] * len(w)
    labels = model.decode([[token_features(tokens, k) for k in range(len(tokens))] for tokens in words])
    more: list[list[Span]] = [[] for _ in texts]
    for (tokens, first), path, k in zip(places, labels, owner, strict=True):
        more[k] += found_spans(tokens, path, first)
    out = []
    for own, added in zip(base, more, strict=True):
        new, at, reach = [], 0, 0
        ends = sorted(own, key=lambda s: s[1])
        for span in sorted(set(added), key=lambda s: (s[1], s[2])):
            while at < len(ends) and ends[at][1] < span[2]:
                reach = max(reach, ends[at][2])
                at += 1
            if reach <= span[1]:
                new.append(span)
        out.append((own, sorted([*own, *new], key=lambda s: (s[1], KINDS.index(s[0])))))
    return out


def find(docs: DataFrame, model: LinearChainCrf) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base, spans (kind:start:end lists).

    Offsets count code points, ends are exclusive. Null texts count as empty and, like texts without finds, give zeros and
    empty lists. Texts of any length are read whole. Repeated rows give repeated results, an empty table none. Columns
    other than doc_id and text aren't read.
    """

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        got = all_spans([t or "" for t in batch.column(1).to_pylist()], model)
        counts = {f"n_{kind}": [sum(s[0] == kind for s in own) for own, _ in got] for kind in KINDS}
        yield {"doc_id": batch.column(0), "base": [spelled(own) for own, _ in got], "spans": [spelled(every) for _, every in got]} | counts

    return per_batch(document_columns(docs), make, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base string, spans string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


# --- a small labelled table -------------------------------------------------------------------------------------------


def sample_texts(n: int = 700, seed: int = 23) -> list[tuple[str, str]]:
    """A labelled table: n (text, spans) pairs with invented words, data written in many ways, and numbers that are none."""

    rng = random.Random(seed)

    def number(k: int) -> str:
        return "".join(rng.choices("0123456789", k=k))

    def card_number() -> str:
        body = number(15)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def word() -> str:
        return "".join(rng.choices("eaonrtsil", k=rng.randrange(1, 9))) + rng.choice(["", "", "", ".", ",", "***", "!!", "###"])

    def grouped(digits: str, sign: str) -> str:
        return sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def email() -> str:
        name = rng.choice(["{a}", "{a}.{b}", "{a}{n}", "{a}_{b}", "{a}.{n}"]).format(a=word().strip(".,*!#"), b="kim", n=number(2))
        host = rng.choice(["mail7", "example", "post-office", "uni"])
        end = rng.choice(["com", "org", "de", "example.com", "co.uk"])
        return rng.choice([f"{name}@{host}.{end}", f"{name} (at) {host} (dot) {end}", f"{name}(at){host}.{end}", f"{name}[at]{host}.{end}", f"{name}@{host}", f"{name} @ {host}.{end}", f"{name} [at] {host} [dot] {end}"])

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+49 {a} {b}{c}", f"+33 1 {a[:2]} {b[:2]} {c[:2]} {c[2:]}", f"00{a[:2]} {b} {c}", f"+{a[:2]}{b}{c}"])

    def ip() -> str:
        parts = [str(rng.randrange(256)) for _ in range(4)]
        return rng.choice([".".join(parts), ".".join(parts), ".".join(parts) + f":{rng.randrange(80, 9999)}", "[.]".join(parts), ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(8))])

    def card() -> str:
        digits = card_number()
        return rng.choice([digits, grouped(digits, " "), grouped(digits, "-"), grouped(digits, ".")])

    makers = {"email": email, "phone": phone, "ip": ip, "card": card}

    def other() -> str:
        bad = card_number()
        return rng.choice(
            [
                number(rng.randrange(1, 7)), f"{rng.randrange(1900, 2030)}-{number(2)}-{number(2)}", f"{number(1)}.{number(1)}", f"v{number(1)}.{number(2)}.{number(1)}", f"{number(2)}:{number(2)}", f'token = "{random.Random(number(9)).getrandbits(160):040x}"',
                bad[:-1] + str((int(bad[-1]) + 1) % 10), f"https://site.example/{number(5)}", f"${number(3)}.{number(2)}", f"{number(3)},{number(3)}", f"@{word().strip('.,*!#')}", f"{number(1)}.{number(1)}.", f"x{number(4)}y", f"{number(20)}", f"{rng.randrange(256, 999)}.{number(3)}.{number(3)}.{number(2)}",
                f"page {number(2)}-{number(2)}", f"{number(4)}/{number(4)}", f"#{number(6)}", f"{number(5)}-{number(4)}",
            ]
        )

    rows = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randrange(1, 5)):
            text += "".join(word() + rng.choice([" ", " ", "\n"]) for _ in range(rng.randrange(1, 6)))
            if rng.random() < 0.6:
                kind = rng.choice(KINDS)
                if rng.random() < 0.4:
                    text += rng.choice(sorted(CUES[kind])) + rng.choice([": ", " ", " = "])
                made = makers[kind]()
                core = re.sub(r":\d{2,4}$", "", made) if made.count(".") == 3 else made
                spans.append((kind, len(text), len(text) + len(core)))
                text += made + rng.choice(["", "", ".", ",", "!!", "***"]) + " "
            elif rng.random() < 0.8:
                text += other() + rng.choice(["", ".", ","]) + " "
        rows.append((text, spelled(spans)))
    return rows


def _parsed(spans: str) -> list[Span]:
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in (spans or "").split(",") if s)]


def fit(labelled: list[tuple[str, str]], **options) -> LinearChainCrf:
    """Train on (text, spans) pairs, spans written as in the results."""

    xs, ys = [], []
    for text, spans in labelled:
        gold = _parsed(spans)
        for tokens, first, _ in _runs(text or ""):
            labels, last = [], None
            for token in tokens:
                hit = next((s for s in gold if s[1] < token.end() and token.start() < s[2]), None)
                labels.append(LABELS.index(f"{'more' if hit == last else 'begin'}-{hit[0]}") if hit else 0)
                last = hit
            xs.append([token_features([t.group() for t in tokens], k) for k in range(len(tokens))])
            ys.append(labels)
    return LinearChainCrf.fit(xs, ys, len(LABELS), **({"forbidden": _FORBIDDEN, "rounds": 90} | options))


def fit_table(labelled: DataFrame, max_rows: int = 20_000, **options) -> LinearChainCrf:
    """Train on a table of (text, spans) columns; at most max_rows rows, chosen by a hash."""

    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("spans").cast("string").alias("spans")).where("text is not null")
    return fit([(r["text"], r["spans"]) for r in rows.orderBy(F.xxhash64("text"), "text").limit(max_rows).collect()], **options)


@lru_cache(maxsize=1)
def default_model() -> LinearChainCrf:
    """The field trained on sample_texts()."""

    return fit(sample_texts())
