"""Language labels as they are delivered, and the ISO 639-1 code each names."""

from __future__ import annotations

import re

# Code, other codes and English name of the languages labels may name.
_NAMES = """
en eng english | de deu ger german | fr fra fre french | es spa spanish | pt por portuguese | it ita italian | nl nld dut dutch | pl pol polish | ru rus russian
ja jpn japanese | zh zho chi chinese cmn | th tha thai | ar ara arabic | hi hin hindi | ca cat catalan | gl glg galician | cs ces cze czech | sk slk slo slovak
bg bul bulgarian | uk ukr ukrainian | sr srp serbian | hr hrv croatian | sl slv slovenian | da dan danish | sv swe swedish | no nor norwegian | nb nob | nn nno | fi fin finnish
ko kor korean | vi vie vietnamese | tr tur turkish | ro ron rum romanian | hu hun hungarian | el ell gre greek | he heb hebrew | fa fas per persian | ur urd urdu
bn ben bengali | mr mar marathi | ne nep nepali | id ind indonesian | ms msa may malay | la lat latin | eu eus baq basque | af afr afrikaans | mk mkd mac macedonian
be bel belarusian | lt lit lithuanian | lv lav latvian | et est estonian | is isl ice icelandic | ga gle irish | cy cym wel welsh | lo lao | km khm khmer | my mya bur burmese
"""
CODES = {w: words[0] for line in _NAMES.strip().splitlines() for words in [p.split() for p in line.split("|")] if words for w in words}


def code_of(label: str | None) -> str | None:
    """The ISO 639-1 code that a label names, by code, English name or either with a region or script; None for a label
    that is null, empty or names no one language (und, mul, zxx, unknown, ??)."""
    if not label:
        return None
    return CODES.get(re.split(r"[-_\s@.]", label.strip().lower(), maxsplit=1)[0])
