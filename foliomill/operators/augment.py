"""Synthetic values and entity replacement (AUG-01..04): seeded by sample and copy, so runs agree."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Parts of case numbers and studies. Fixed values.
CASE_PREFIXES = ("IPP", "CAU", "DEB", "INC")
STUDY_LEVELS, STUDY_STATUS = ("primarios", "secundarios", "terciarios", "universitarios"), ("completos", "incompletos", "en curso")

FIRST = "Alex Ariel Noa Cruz Sol Dani Eli Rene Andrea Guadalupe".split()
LAST = "Molina Ferreyra Acosta Ibarra Luna Quiroga Sosa Vega Bustos Ledesma Roldan Ortiz".split()
STREETS = "Mitre Belgrano Sarmiento Alvear Urquiza Lavalle Maipu Salta".split()
PLACES = (("Villa del Lago", "Rosario", "Santa Fe"), ("Los Alamos", "Lujan", "Buenos Aires"), ("El Ceibo", "Parana", "Entre Rios"))
NATIONS = "argentina uruguaya paraguaya boliviana chilena peruana brasilera colombiana".split()
BANKS = (("007", "Banco de Galicia"), ("011", "Banco de la Nacion"), ("014", "Banco Provincia"), ("029", "Banco Ciudad"))
CARS = {"Fiat": ("Uno", "Palio"), "Renault": ("Clio", "Kangoo"), "Ford": ("Fiesta", "Focus"), "Peugeot": ("208", "Partner")}
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _grouped(r: random.Random, number: str, cuts: tuple[int, ...]) -> str:
    """Digits in groups of three from the right, dotted, plain or spaced."""
    mark = r.choices((".", "", " "), (0.7, 0.2, 0.1))[0]
    out = number
    for cut in cuts:
        if len(number) > cut:
            at = len(number) - cut
            out = out[:at] + mark + out[at:]
    return out


def _name(r: random.Random) -> str:
    words = [r.choice(FIRST), *(r.choice(LAST) for _ in range(r.randint(1, 4)))]
    return " ".join(words) if r.random() < 0.25 else r.choices((".", ". "), (0.25, 0.75))[0].join(w[0] for w in words)


def _date(r: random.Random) -> str:
    d, m, y = r.randint(1, 28), r.randint(1, 12), r.randint(1970, 2024)
    return r.choice((f"{d:02d} de {MONTHS[m - 1]} del {y}", f"{d:02d} de {MONTHS[m - 1]} de {y}", f"{d:02d}-{m:02d}-{y % 100:02d}", f"{d:02d}-{m:02d}-{y}", f"{d:02d}/{m:02d}/{y % 100:02d}", f"{d:02d}/{m:02d}/{y}"))


def _address(r: random.Random) -> str:
    return r.choices((f"{r.choice(STREETS)} {r.randint(1, 9999)}", f"{r.choice(STREETS)} y {r.choice(STREETS)}", r.choice(STREETS)), (0.6, 0.3, 0.1))[0]


def _place(r: random.Random) -> str:
    place = r.choice(PLACES)
    return ", ".join(place[: r.choice((1, 2, 3, 3))])


def _age(r: random.Random) -> str:
    if r.random() < 0.8:
        return str(r.randint(1, 100))
    months = r.randint(1, 12)
    return f"{months} mes" if months == 1 else f"{months} meses"


def _phone(r: random.Random) -> str:
    parts = [r.choice(("11", "341", "351")), _digits(r, 4), _digits(r, 4)]
    prefix = "+54 9 " if r.random() < 0.05 else ""
    return prefix + r.choices(("", "-", " "), (0.4, 0.4, 0.2))[0].join(parts)


def _plate(r: random.Random) -> str:
    letters = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    parts = (letters(2), _digits(r, 3), letters(2)) if r.random() < 0.5 else (letters(3), _digits(r, 3))
    return (" " if r.random() < 0.25 else "").join(parts)


def _cuit(r: random.Random) -> str:
    parts = (r.choice(("20", "23", "24", "25", "26", "27", "30")), _digits(r, 8), _digits(r, 1))
    return ("" if r.random() < 0.1 else "-").join(parts)


def _car(r: random.Random) -> str:
    brand = r.choice(sorted(CARS))
    return f"{brand} {'modelo ' if r.random() < 0.5 else ''}{r.choice(CARS[brand])}"


def _cuij(r: random.Random) -> str:
    last = _digits(r, 1)
    return f"{r.choice(CASE_PREFIXES)} J-{_digits(r, 2)}-{_digits(r, 8)}-{last}/{r.randint(1990, 2100)}-{last}"


def _user(r: random.Random) -> str:
    return f"{r.choice(FIRST)}{r.choice(LAST)}{r.randint(1, 99)}".lower()


GENERATORS: dict[str, Callable[[random.Random], str]] = {
    "PER": _name,
    "EDAD": _age,
    "DNI": lambda r: _grouped(r, str(r.randint(1_000_000, 99_999_999)), (3, 6)),
    "NACIONALIDAD": lambda r: r.choice(NATIONS),
    "ESTUDIOS": lambda r: f"estudios {r.choice(STUDY_LEVELS)} {r.choice(STUDY_STATUS)}",
    "PASAPORTE": lambda r: r.choice("ABC") + "AB" + _digits(r, 6),
    "NUM_MATRICULA": lambda r: _grouped(r, _digits(r, r.randint(5, 6)), (3,)),
    "DIRECCION": _address,
    "LOC": _place,
    "FECHA": _date,
    "NUM_EXPEDIENTE": lambda r: f"{r.choice(CASE_PREFIXES)} {_digits(r, r.randint(3, 7))}/{r.randint(1990, 2100)}-{_digits(r, 1)}",
    "CUIJ": _cuij,
    "NUM_ACTUACION": lambda r: f"{_digits(r, r.randint(2, 7))}/{r.randint(1990, 2100)}",
    "CORREO_ELECTRONICO": lambda r: f"{_user(r)}@correo.example.com",
    "USUARIX": _user,
    "LINK": lambda r: f"https://{r.choice(LAST).lower()}.example.com/{_user(r)}",
    "NOMBRE_ARCHIVO": lambda r: f"{_user(r)}.{r.choice(('pdf', 'docx', 'jpg', 'mp4'))}",
    "IP": lambda r: ".".join(str(r.randint(0, 255)) for _ in range(4)),
    "CUIT_CUIL": _cuit,
    "TELEFONO": _phone,
    "BANCO": lambda r: r.choice(BANKS)[1],
    "CBU": lambda r: r.choice(BANKS)[0] + _digits(r, 19),
    "NUM_CAJA_AHORRO": lambda r: _digits(r, 2) + r.choice(("0200", "0210")) + _digits(r, 12),
    "MARCA_AUTOMOVIL": _car,
    "PATENTE_DOMINIO": _plate,
}

_CASES = (str, str.lower, str.upper, str.title, str.capitalize)


def replace_entities(tokens: list[str], tags: list[str], r: random.Random) -> tuple[list[str], list[str]]:
    """New values for the runs of equal labels; labels without a generator stay as they are."""
    plain = [t.removeprefix("B-").removeprefix("I-") for t in tags]
    out, out_tags, i = [], [], 0
    while i < len(tokens):
        j = i + 1
        while j < len(tokens) and plain[j] == plain[i]:
            j += 1
        if plain[i] in GENERATORS:
            words = GENERATORS[plain[i]](r).split()
            out += words
            out_tags += [f"{'I' if k else 'B'}-{plain[i]}" for k in range(len(words))]
        else:
            out += tokens[i:j]
            out_tags += tags[i:j]
        i = j
    case = r.choice(_CASES)
    return [case(t) for t in out], out_tags


def augment(samples: DataFrame, n_copies: int, seed: int = 42) -> DataFrame:
    """``n_copies`` changed copies of each (hash, tokens, tags by name)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                for copy in range(1, n_copies + 1):
                    r = random.Random(f"{seed}:{row.hash}:{copy}")
                    tokens, tags = replace_entities(list(row.tokens), list(row.tags), r)
                    rows.append((row.hash, copy, tokens, tags, sum(t != "O" for t in tags), hashlib.sha256(" ".join(tokens).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["original_hash", "copy_no", "tokens", "tags", "n_labels", "hash"])

    return samples.select("hash", "tokens", "tags").mapInPandas(run, "original_hash string, copy_no int, tokens array<string>, tags array<string>, n_labels int, hash string")
