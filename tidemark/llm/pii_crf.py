"""Personal data: exact base patterns, and a linear-chain CRF over word shapes for the rest.

The base kinds (email, ip, card, phone) are regular expressions with checks. The random
field labels the words of each line (parted by whitespace, after the = or : of a name and
the :// of a link, at an @, and after a -p) from their shapes (classes of characters, length, hexadecimal or not), cue words before
them and the shapes beside them. It is trained from a small table of labelled lines and
decoded by Viterbi for all lines of a batch in step. Its spans (secret, ssn, iban, phone
without a country code, email written out) are added where they touch no base span, but for a password before
an @, in which the base patterns see an address; an iban, an ssn, a phone number and a written-out email must look like one as a whole, and a
secret is no plain word.

All of a text's words are labelled by features of the whole word, and a span covers whole words.

Edge cases: a null text is empty and has no spans; texts are read whole, in linear time
whatever they hold; of equally likely labels the first in LABELS is taken; repeated rows
are judged alike; an empty table gives no rows; extra columns are ignored by ``find`` and
kept by ``redact``.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import crf
from tidemark.llm.common import by_batch

BASE_KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O", "email", "iban", "phone", "secret", "ssn"]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: linear for any text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start and then in the kinds' order."""
    out = [(a, b, "email") for a, b in emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = digits_of(m.group()) if m.end() - m.start() <= 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(digits_of(m.group())) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


# --- the random field -------------------------------------------------------------

BUCKETS = 8192
#: Cue words, in four languages, by what they announce.
_CUE_WORDS = [
    "token key api_key apikey api-key secret password passwd bearer pw pwd pass passphrase passwort credential credentials access_token auth client_secret kennwort passe contraseña clave geheim basic -p",
    "ssn social", "iban account konto compte cuenta",
    "call tel phone fax telefon mobile ring text dial handy mobilnummer nummer rufen anrufen appelez appeler joindre cell büro marque llamar téléphone tél portable numéro llame teléfono móvil número number",
    "mail email contact write reach e-mail kontakt schreiben écrivez courriel escriba correo", "at arroba arobase", "dot punkt point punto underscore dash", "= : := =>",
    "is was ist war lautet est es", "no order ref ticket invoice serial part isbn page version item rechnung bestellung facture commande pedido", "commit sha sha1 sha256 md5 hash checksum revision rev digest uuid id",
    "code codes otp pin tan passcode código tan-code pin-code one-time", "zip area error postal postleitzahl", "must muss doit debe should soll", "://", "@",
]
CUES = {w: k for k, words in enumerate(_CUE_WORDS, 1) for w in words.split()}
N_CUES, N_COARSE = len(_CUE_WORDS) + 2, 8  # the last cue stands for the edge of a line

_EDGE = "\"'`.,;:!?()[]{}<>*#$%&|=-"
#: The scheme of a link, a name with the sign that ties it to a value, a -p before one, an @, or a word.
_TIED = re.compile(r"[A-Za-z][\w+.-]*://(?=\S)|[A-Za-z_][\w.-]*[=:]+(?=[^\s=:/])|(?<!\S)-[pP](?=[^\s-]*[0-9!$%&#*?])|@|[^\s@]+")
_SPACED = re.compile(r"\S+")
#: An address in one word whose signs are written out.
_WRITTEN = re.compile(r"\w[\[(]at[\])]\w", re.I)


class _Classes(dict):
    """Of a code point: 9 for a digit, X for A-Z, x for other letters; else itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "9" if "0" <= c <= "9" else "X" if "A" <= c <= "Z" else "x" if c.isalnum() else c
        return out


_SHAPE = _Classes()
#: What a span of a kind must look like as a whole.
_LOOKS = {
    "email": re.compile(
        r"\S+(?: [\[(]?(?:dot|punkt|point|punto|underscore|dash)[\])]? \S+)* [\[(]?(?:at|arroba|arobase)[\])]? \S+(?: [\[(]?(?:dot|punkt|point|punto)[\])]? \S+)+"
        r"|[^\s\[\]()]+[\[(]at[\])][^\s\[\]()]+(?:[\[(]dot[\])][^\s\[\]()]+)+", re.I),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){10,30}"),
    "phone": re.compile(r"[(]?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}"),
    "secret": re.compile(r"(?=\S*(?:[^A-Za-zÀ-ÿ]|[a-z][A-Z]))\S{6,}|(?=\S*[0-9])(?=\S*[^\w\s])\S{5}|[0-9]{4,8}|[0-9]{3}[ -][0-9]{3}"),
    "ssn": re.compile(r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}"),
}


#: Padding that belongs to a value.
_PADDED = re.compile(r"[A-Za-z0-9+/_-]{12,}={1,2}")


def tied(line: str) -> bool:
    return "=" in line or ":" in line or "@" in line or "-p" in line or "-P" in line


def words_of(line: str) -> list[str]:
    return _TIED.findall(line) if tied(line) else line.split()


_HEX = re.compile(r"[0-9a-fA-F]+")


def cue_of(word: str) -> int:
    return CUES.get(word if word in ("=", ":", ":=", "=>", "@") else "://" if word.endswith("://") else word.lower().strip("\"'.,;:()[]<>="), 0)


def word_shape(word: str) -> tuple[list[int], int, int]:
    """Feature numbers of a word, its cue and its coarse class."""
    core = word.strip(_EDGE)
    shape = core.translate(_SHAPE)
    short = re.sub(r"(.)\1+", r"\1", shape)
    short = short if len(short) <= 24 else "long"
    size = min(len(core), 8) if len(core) < 8 else 8 + min(len(core) // 4, 12)
    long_hex = len(core) >= 16 and bool(_HEX.fullmatch(core)) and any(c.isdigit() for c in core) and any(c.isalpha() for c in core)
    mixed = sum(a != b for a, b in zip(shape, shape[1:]))
    cue = cue_of(word)
    coarse = 0 if not core else 1 if core.isalpha() else 2 if core.isdigit() else 3 if long_hex else 4 if any(c.isdigit() for c in core) else 5
    names = [f"s{short}", f"n{size}", f"h{long_hex}", f"m{min(mixed, 10)}", f"c{cue}", f"e{shape}" if len(shape) <= 24 else "e", f"a{bool(_WRITTEN.search(word))}", f"q{word[:1] in _EDGE}{coarse}", f"z{core[:1] == '0'}{size}", f"p{core[:3]}" if len(core) >= 16 else "p", f"t{word[-1:] in '=:'}{cue}"]
    return [zlib.crc32(n.encode()) % BUCKETS for n in names], cue, coarse


def around(cue: np.ndarray, coarse: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Feature numbers (after BUCKETS) of the cues of three words before and two after each
    word and the classes of the words beside it."""
    ends = np.cumsum(lengths)
    place = np.arange(len(cue)) - np.repeat(ends - lengths, lengths)
    left = np.repeat(ends, lengths) - np.arange(len(cue)) - 1
    out, base = [], BUCKETS
    for back in (1, 2, 3):
        near = np.full(len(cue), N_CUES - 1)
        near[back:] = cue[:-back] if back < len(cue) else near[back:]
        out.append(base + np.where(place >= back, near, N_CUES - 1))
        base += N_CUES
    for ahead in (1, 2):
        near = np.full(len(cue), N_CUES - 1)
        near[:-ahead] = cue[ahead:] if ahead < len(cue) else near[:-ahead]
        out.append(base + np.where(left >= ahead, near, N_CUES - 1))
        base += N_CUES
    for step, inside in ((1, place >= 1), (-1, left >= 1)):
        out.append(base + np.where(inside, np.roll(coarse, step), N_COARSE - 1))
        base += N_COARSE
    return out


N_FEATURES = BUCKETS + 5 * N_CUES + 2 * N_COARSE


@dataclass
class PiiModel:
    weight: np.ndarray
    transit: np.ndarray
    known: dict = field(default_factory=dict)
    shared: dict = field(default_factory=dict)
    rows: np.ndarray = field(default_factory=lambda: np.zeros((0, len(LABELS))))
    tags: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))

    def label(self, lines: list[list[str]]) -> np.ndarray:
        """Label numbers of all words of all (non-empty) lines, end to end."""
        words = [w for x in lines for w in x]
        new = [w for w in set(words) if w not in self.known]
        if len(self.known) + len(new) > 300_000:
            self.known, self.shared, self.rows, self.tags, new = {}, {}, self.rows[:0], self.tags[:0], list(set(words))
        if new:
            # Words without digits or cues that have one shape share a row.
            keys = [k if "9" not in (k := w.translate(_SHAPE)) and not cue_of(w) and not _WRITTEN.search(w) else w for w in new]
            fresh = [k for k in dict.fromkeys(keys) if k not in self.shared]
            shapes = [word_shape(k) for k in fresh]
            self.shared.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh))))
            self.known.update((w, self.shared[k]) for w, k in zip(new, keys))
        if new and fresh:
            self.rows = np.concatenate([self.rows, crf.emissions(self.weight, list(np.array([s[0] for s in shapes]).T))])
            self.tags = np.concatenate([self.tags, np.array([s[1:] for s in shapes])])
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        beside = around(self.tags[at, 0], self.tags[at, 1], lengths)
        return crf.viterbi(self.rows[at] + crf.emissions(self.weight, beside), lengths, self.transit)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the labelled words of each text; adjacent ones joined."""
        out: list[list] = [[] for _ in texts]
        lines, places, size = [], [], 0
        for i, text in enumerate(texts):
            begin = 0
            for line in text.split("\n"):
                if words := words_of(line):
                    lines.append(words)
                    places.append((i, begin))
                    size += len(words)
                begin += len(line) + 1
            if size >= 400_000 or i == len(texts) - 1:
                self._collect(texts, lines, places, out)
                lines, places, size = [], [], 0
        return out

    def _collect(self, texts: list[str], lines: list[list[str]], places: list[tuple], out: list[list]) -> None:
        if not lines:
            return
        label = self.label(lines)
        ends = np.cumsum([len(x) for x in lines])
        found = np.flatnonzero(label)
        for k in np.unique(np.searchsorted(ends, found, "right")):
            i, begin = places[k]
            stop = texts[i].find("\n", begin)
            line = texts[i][begin : stop if stop >= 0 else None]
            words = [m.span() for m in (_TIED if tied(line) else _SPACED).finditer(line)]
            marks = label[ends[k] - len(lines[k]) : ends[k]]
            at = 0
            while at < len(marks):
                if not marks[at]:
                    at += 1
                    continue
                last = at
                while last + 1 < len(marks) and marks[last + 1] == marks[at]:
                    last += 1
                a, b = begin + words[at][0], begin + words[last][1]
                whole = texts[i][a:b]
                edge = _EDGE.replace("(", "") if marks[at] == LABELS.index("phone") else _EDGE
                a, b = a + len(whole) - len(whole.lstrip(edge)), b - len(whole) + len(whole.rstrip(_EDGE))
                kind = LABELS[marks[at]]
                if kind == "secret" and (m := _PADDED.match(texts[i], a)) and m.end() > b:
                    b = m.end()
                if a < b and (kind not in _LOOKS or _LOOKS[kind].fullmatch(texts[i], a, b)):
                    out[i].append((a, b, kind))
                at = last + 1


# --- the labelled table -----------------------------------------------------------

#: Lines with the labelled part in braces, as kind and pattern: 9 a digit,
#: h a hexadecimal digit, b a base-62 character, q a sign, X a capital letter, w a made-up word,
#: what angle brackets hold as it stands; ~ is one of PASSWORDS.
PASSWORDS = [
    "Xw9", "Xw99", "Xw999", "Xw9999", "Xwq99", "Xwq9999", "Xwq", "w99", "w9999", "w-w", "w-w-99", "w-w-w", "w-w9", "w_w_9", "w.w99", "Xw-Xw-9", "XwXw99", "XwqXw9", "99w99", "9999bXbX", "9w9w", "wqw9", "w9qw9", "qw99", "9q9w9",
    "bbqbbb9", "bq9bXq", "b9b9b9b9", "bbbbbbbbbbbb", "bbbbbb99bbbbbb", "X9b9bXb9", "qqw9", "Xw-w-w-9", "w9-w9", "Xwqq", "bbbb-bbbb-bbbb", "X99wX9w",
]
FRAMES = [
    "password: {secret:~}", "w password: {secret:~} w w", "password {secret:~} w w", "w w password {secret:~} w", "w password is {secret:~} w w", "password is {secret:~}, w", "the password was {secret:~}.", "w w: {secret:~}@w.w", "w w w password {secret:~}, w w",
    "pw {secret:~} w w", "w pw {secret:~}", "pw={secret:~}", "w pw: {secret:~}, w", "w pwd={secret:~} w w", "pwd {secret:~}", "pass: {secret:~} w", "w passwd: {secret:~}", "secret: {secret:~}", "secret={secret:~} w", "w login w:{secret:~}@w.w.com w", "w://w:{secret:~}@w.w:9999/w w",
    "w -u w -p{secret:~} w", "passwort: {secret:~}", "w w, passwort {secret:~}, w w", "w passwort ist {secret:~} w", "w passwort lautet {secret:~}, w w", "kennwort: {secret:~} (w w)", "w kennwort lautet {secret:~}, w", "w kennwort ist {secret:~}.",
    "w mot de passe est {secret:~} w w", "mot de passe : {secret:~}", "w mot de passe {secret:~}, w", "mot de passe: {secret:~}", "la contraseña es {secret:~} w w", "contraseña: {secret:~} w", "w contraseña {secret:~}, w", "w=w clave={secret:~}", "clave: {secret:~}", "w clave es {secret:~}.",
    "code is {secret:999 999}, w w", "w code: {secret:999 999}", "enter {secret:999 999} w w code", "use {secret:999999} w w code w", "w code w w : {secret:999 999}", "w w code w w : {secret:999999}", "w code : {secret:999 999}", "w code is {secret:999 999} w", "w code ist {secret:999 999}.", "tan-code: {secret:999999}", "w pin-code {secret:9999} w",
    "w appeler le {phone:09 99 99 99 99} w w", "w le {phone:09 99 99 99 99} w", "w au {phone:09 99 99 99 99}, w", "w w w {phone:0999/999999}.", "w w w w {phone:099/9999999} w", "w: {phone:0999/9999999}", "teléfono {phone:999999999}", "marque el {phone:999 999 999} w", "w el {phone:999 99 99 99}, w", "her cell, {phone:999-999-9999}, w",
    "{iban:XX99 9999 9999 9999}", "{iban:XX99 9999 9999 9999 9999 99}", "{iban:XX99999999999999}", "w w {iban:XX99 XXXX 9999 9999 9999 99}.", "w w w {iban:XX9999999999999999999999}, w", "w {iban:XX99 9999 9999 99XX 9999 9999 999} w", "w social security {ssn:999 99 9999} w", "social {ssn:999 99 9999}", "w w ssn {ssn:999 99 9999}, w", "w: {ssn:999-99-9999}", "w w w w w {ssn:999-99-9999}",
    "w w {email:w[at]w[dot]com}.", "w {email:w[at]w[dot]w} w", "{email:w(at)w(dot)com}", "mail {email:w(at)w(dot)w} w", "w w {email:w(at)w[dot]net} w", "w w a {email:w arroba w punto com}.", "w w à {email:w arobase w point org}, w", "w an {email:w punkt w at w punkt de} w", "{email:w at w punkt de}", "w an {email:w at w punkt com} w w", "mail w {email:w at w dot com} w",
    "passphrase = {secret:~}", "w passphrase is {secret:~} w w", "w passphrase: {secret:~}", "w w w token {secret:~} w", "token={secret:~}; w w", "w auth={secret:~}; w", "w key {secret:~} w w", "api key = {secret:~}, w w", "bearer {secret:~} w w", "w w (password {secret:~}) w",
    'w w w token = "{secret:hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh}" w w',
    "w, w token = {secret:hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh} w w w.",
    "TOKEN = \"{secret:hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh}\"!! W!! W!!",
    "w w api_key: {secret:bbbbbbbbbbbbbbbbbbbbbbbb} w", "w key = '{secret:bbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb}' w w w", "password = {secret:bbbbbbbbbb99} w w", "w password is {secret:bbbb99bbbb}. w w",
    "bearer {secret:bbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb} w w", "w w secret = \"{secret:hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh}\"### w&&& w***",
    "w ssn {ssn:999-99-9999} w w", "w w w ssn: {ssn:999-99-9999}, w.", "social security {ssn:999-99-9999} w", "w {ssn:999-99-9999} w w",
    "iban {iban:XX99 9999 9999 9999 9999 99} w w", "w w iban: {iban:XX99XXXX99999999999999} w", "w account {iban:XX9999999999999999999} w w",
    "call {phone:(999) 999-9999} w w", "w tel {phone:999-999-9999} w.", "w phone: {phone:(999) 999-9999}, w w w", "w w w {phone:(999) 999-9999} w w", "w? {phone:(999) 999-9999}", "w w {phone:(999) 999-9999}.",
    "mail {email:w at w dot com} w w", "w email {email:w at w dot org} w", "contact {email:w at mail9 dot net}, w w",
    "w w w w w w w w. W w w w, w w.", "W w w. W w w w w w.", "w 9999 w w 99 w, w 999999 w.", "w w 9999-99-99 w w 99:99 w", "w v9.9.9 w w 99.9% w $99.99 w",
    "W!! W!! W!! W,!! W!! W!!", "w### w*** w&&& w$$$ w,%%% w.### w", "w | w | w, | W | w.", "w 9999999999999999 w w", "w w +9 (999) 999-9999 w w", "w 99.999.99.999 w w w.99@mail9.example.com w",
    "w w in the key of w w is w", "w token of w w, w at w w", "the token is w w w. w is w", "w account of w w w", "w call w w w, w mail w w", "w at w w. w dot w w", "W at the w, w.", "w secret w w, password w w.",
    "password: {secret:w99}", "w password: {secret:w9999} w w", "pw={secret:bbqbqbbb} w", "w pw: {secret:qbbbqbbq9}, w w", "pwd={secret:bbbbbbqq99}", "passwort = {secret:w99q} w", "w w passphrase is {secret:w-w-w9} w", "the password is {secret:wq99} w w", "password was {secret:bbb9bbbb}. W w",
    "w secret key {secret:<AKIA>XXXX99XXXX99XXXX} w", "{secret:<AKIA>XXX9XXX99XX9XXXX} w w", "w w {secret:<ghp_>bbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb} w", "token: {secret:<ghp_>bbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb}", "export TOKEN={secret:<ghp_>bbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb}", "w {secret:<sk_live_>bbbbbbbbbbbbbbbbbbbbbbbb} w", "auth {secret:<eyJ>bbbbbbbbbbbbbb.<eyJ>bbbbbbbbbbbbbbbbbbb.bbbbbbbbbbbbbbbbb} w", "client_secret={secret:bbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb}", "api_key={secret:hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh} w", "access_token => '{secret:bbbbbbbbbbbbbbbbbbbbbbbbbbbb}'", "w api-key: {secret:hhhhhhhh-hhhh-hhhh-hhhh-hhhhhhhhhhhh} w", "w {secret:<xoxb->999999999999-bbbbbbbbbbbbbbbbbbbbbbbb} w w",
    "call {phone:099 9999 9999} w w", "w w {phone:09999 999999} w", "ring {phone:09999 999 999}, w", "tel {phone:09 99 99 99 99} w", "w mobile: {phone:0999 9999999} w", "fax {phone:0999/9999999} w w", "w phone {phone:999.999.9999} w", "text {phone:999-999-9999} w w", "w w {phone:999-999-9999}, w w", "telefon: {phone:099 99999999}", "w tel. {phone:(099) 9999 9999} w w",
    "write {email:w dot w at w dot com} w", "w w reach w {email:w at w dot w dot org}, w", "w {email:w dot w at w dot net} w w", "mail {email:w (at) w (dot) com} w", "w: {email:w (at) w (dot) de}", "email: {email:w (at) w (dot) net}, w", "email: {email:w [at] w [dot] org} w w", "{email:w9 at w dot com} w",
    "w iban: {iban:XX99 XXXX 9999 9999 9999 99} w", "w w {iban:XX99 9999 9999 9999 9999 9999 999} w", "iban {iban:XX999999999999999999} w", "w {iban:XX9999999999999999999999} w w", "w w account {iban:XX99XXXX9999999999} w w w", "iban: {iban:XX99999999999999999X99999}", "w {iban:XX99XXXX9999999999}, w", "konto: {iban:XX99 9999 9999 9999 9999} w",
    "social {ssn:999 99 9999} w w", "w w ssn={ssn:999-99-9999} w", "w social security no. {ssn:999-99-9999}, w", "ssn is {ssn:999-99-9999}. w",
    "w 9999 9999 9999 9 w w", "w 9999 9999 9999 9999, w", "order no. 999-99-9999 w w", "w w order 999-99-9999 w", "part no. 999-99-9999 w", "ref 999-999-9999 w w", "w invoice 999-9999-9999, w w", "ticket no. 999-999-9999 w",
    "commit hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh w w", "w w sha hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh w", "md5: hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh w", "w checksum hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh", "w revision hhhhhhhhhhhh w w", "w w hash = hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh w", "uuid: hhhhhhhh-hhhh-hhhh-hhhh-hhhhhhhhhhhh w", "id=hhhhhhhhhhhhhhhhhhhhhhhh w",
    "w: w w; w=w w:w", "w=99 w w=w9 w", "key: w w w", "w key=w w w", "the password was w w, w w", "w pass w w w", "w text w w w", "w auth w w", "page 999 w w 999 w", "w 099 w 0999 w w", "w 99 99 99 w", "w item 99-999-9999 w w", "w 9,999,999 w w $9,999.99 w", "w w at 99:99 w w at 9 w", "w w was 99 w", "https://w.w.com/w?w=99&w=w w", "w_w w.w() w[9] = w;", "w version 99.9.9 w w 9.9.9-w9",
    "w w 9999 999-9999 w w", "w no. 99-9999 w w w", "(w) w [99] w - w w; w: w!", "w ref hhhh w w", "w isbn 999-9-99-999999-9 w w", "https://w.example.com/w/9999 w w", "© 9999 W W. w w",
]


def labelled_table(copies: int = 6, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of each labelled line: every frame with ``copies`` fillings."""
    rnd = random.Random(seed)
    parts = "an er the on ing sch keit eau tion ó ñ ou aux ge ver ll de la st wh é ü".split()
    alphabet = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"

    def fill(pattern: str, kind: str | None) -> str:
        made = {"9": lambda: rnd.choice("0123456789"), "h": lambda: rnd.choice("0123456789abcdef"), "b": lambda: rnd.choice(alphabet), "X": lambda: rnd.choice("ABDEFGIKLNPRST"), "q": lambda: rnd.choice("!$%&#@*?_+")}
        if kind is None or kind == "email":
            word = lambda m: "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4)))
            pattern = re.sub(r"\bW\b", lambda m: word(m).title() if rnd.random() < 0.6 else word(m).upper(), re.sub(r"\bw\b", word, pattern))
            return re.sub(r"9|\bh{4,}\b", lambda m: "".join(made[c]() for c in m.group()), pattern)
        pattern = rnd.choice(PASSWORDS) if pattern == "~" else pattern
        made["w"] = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randrange(2, 4)))
        value = re.sub(r"<([^>]*)>|.", lambda m: m.group(1) or (made[m.group()]() if m.group() in made else m.group()), pattern)
        return value.upper() if set(pattern) == {"h"} and rnd.random() < 0.3 else value

    out = []
    for frame in FRAMES:
        for _ in range(copies * (1 + ("~" in frame))):
            words, labels, cut = [], [], 0
            pieces = [(m.start(), m.end(), m.group(1), m.group(2)) for m in re.finditer(r"\{(\w+):([^}]*)\}", frame)]
            text, marks = "", []
            for a, b, kind, pattern in pieces:
                text += fill(frame[cut:a], None)
                value = fill(pattern, kind)
                marks.append((len(text), len(text) + len(value), kind))
                text, cut = text + value, b
            text += fill(frame[cut:], None)
            if rnd.random() < 0.4:
                text = text[:1].upper() + text[1:]
            for m in (_TIED if tied(text) else _SPACED).finditer(text):
                words.append(m.group())
                labels.append(next((k for a, b, k in marks if m.start() < b and m.end() > a), "O"))
            out.append((words, labels))
    return out


def train(table: list[tuple[list[str], list[str]]] | None = None) -> PiiModel:
    table = table or labelled_table()
    lengths = np.array([len(w) for w, _ in table])
    shapes = [word_shape(w) for words, _ in table for w in words]
    features = list(np.array([s[0] for s in shapes]).T)
    tags = np.array([s[1:] for s in shapes])
    labels = np.array([LABELS.index(x) for _, marks in table for x in marks])
    weight, transit = crf.fit(features + around(tags[:, 0], tags[:, 1], lengths), lengths, labels, N_FEATURES, len(LABELS), epochs=30, batch=32)
    return PiiModel(weight, transit)


# --- the operator -----------------------------------------------------------------


def all_spans(texts: list[str | None], model: PiiModel) -> list[tuple[list, list]]:
    """Base spans of each text, and the model's that touch none of them."""
    texts = [t or "" for t in texts]
    out = []
    for text, more in zip(texts, model.spans(texts)):
        base = base_spans(text)
        # In user:password@host the base patterns see an address; the password in it is added all the same.
        inside = lambda s: next((k == "email" and s[2] == "secret" and text[s[0] - 1 : s[0]] == ":" and text[s[1] : s[1] + 1] == "@" for a, b, k in base if s[0] < b and a < s[1]), True)  # noqa: B023, E731
        out.append((base, [s for s in more if inside(s)]))
    return out


def find(docs: DataFrame, model: PiiModel) -> DataFrame:
    """(doc_id, base, added) of every row: arrays of (start, end, kind) in code points."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = "array<struct<start:int,end:int,kind:string>>"
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = all_spans(batch.column("text").to_pylist(), shared.value)
        rows = [[[dict(zip(("start", "end", "kind"), s)) for s in spans] for spans in part] for part in (map(lambda f: f[0], found), map(lambda f: f[1], found))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows[0], arrow), pa.array(rows[1], arrow)], ["doc_id", "base", "added"])

    return docs.select("doc_id", "text").mapInArrow(by_batch(one), f"doc_id {kind}, base {span}, added {span}")


def redact(docs: DataFrame, model: PiiModel) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        out = []
        for text, (base, added) in zip(texts, all_spans(texts, model)):
            at, parts = 0, []
            for a, b, kind in sorted(base + added):
                if a >= at:
                    parts += [text[at:a], f"<{kind}>"]
                at = max(at, b)
            out.append(None if text is None else "".join(parts) + text[at:])
        return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    return docs.mapInArrow(by_batch(one), docs.schema)


def joined(spans: str) -> F.Column:
    """kind:start:end of each span, by start, then base kinds as listed, then the others."""
    rank = "array_position(array('email', 'ip', 'card', 'phone'), x.kind)"
    key = f"struct(x.start, if({rank} = 0, 9, {rank}) as rank, x.kind, x.end)"
    return F.expr(f"array_join(transform(array_sort(transform({spans}, x -> {key})), x -> concat_ws(':', x.kind, x.start, x.end)), ',')")
