"""Names of countries beside the short English ones: those of the standard, common and former ones, and official forms."""

from __future__ import annotations

import re
import unicodedata

#: Other names in use (fixed values, after ISO 3166): code, then names with semicolons between them.
OTHER_NAMES = """
AE the United Arab Emirates
AR Argentine Republic
AX Åland Islands
BA Bosnia and Herzegovina
BN Brunei Darussalam
BO Bolivia, Plurinational State of
BQ Bonaire, Sint Eustatius and Saba
BS The Bahamas
CC Cocos (Keeling) Islands
CD Congo, The Democratic Republic of the; Democratic Republic of the Congo; DR Congo; Zaire
CF Central African Republic
CG Congo; Republic of the Congo
CH Swiss Confederation
CI Côte d'Ivoire; Ivory Coast
CV Cabo Verde; Cape Verde
CZ Czechia; Czech Republic
DO Dominican Republic
EG Arab Republic of Egypt
FK Falkland Islands (Malvinas)
FM Micronesia, Federated States of; Micronesia; Federated States of Micronesia
FR French Republic
GA Gabonese Republic
GB United Kingdom of Great Britain and Northern Ireland; Britain
GM Gambia; The Gambia
GR Hellenic Republic
HK Hong Kong; Hong Kong Special Administrative Region of China
HM Heard Island and McDonald Islands
HU Republic of Hungary
IR Iran, Islamic Republic of
IT Italian Republic
JO Hashemite Kingdom of Jordan
KG Kyrgyz Republic
KN Saint Kitts and Nevis
KP Korea, Democratic People's Republic of; Democratic People's Republic of Korea
KR Korea, Republic of; Republic of Korea; Korea
LA Lao People's Democratic Republic
LB Lebanese Republic
LC Saint Lucia
LK Democratic Socialist Republic of Sri Lanka
LY State of Libya
MD Moldova, Republic of
MF Saint Martin (French part)
MK Macedonia; The former Yugoslav Republic of Macedonia
MM Burma
MO Macao; Macau; Macao Special Administrative Region of China
MX United Mexican States
NG Federal Republic of Nigeria
NP Federal Democratic Republic of Nepal
PM Saint Pierre and Miquelon
PN Pitcairn
PS Palestine, State of; Palestine; the State of Palestine
PT Portuguese Republic
RU Russian Federation
SH Saint Helena, Ascension and Tristan da Cunha
SK Slovak Republic
ST Sao Tome and Principe
SX Sint Maarten (Dutch part)
SY Syrian Arab Republic
SZ Swaziland
TG Togolese Republic
TL Timor-Leste; East Timor
TR Türkiye; Turkey; Republic of Türkiye
TW Taiwan, Province of China
TZ Tanzania, United Republic of
US the United States of America
UY Eastern Republic of Uruguay
VA Holy See (Vatican City State); Holy See
VC Saint Vincent and the Grenadines
VE Venezuela, Bolivarian Republic of
VG Virgin Islands, British
VI Virgin Islands, U.S.; Virgin Islands of the United States
VN Viet Nam
"""

#: Official forms and the codes of the countries whose name follows them (fixed values).
FORMS = {
    "Republic of": "AL AM AO AT AZ BG BI BJ BW BY CG CI CL CM CO CR CU CV CY DJ EC EE FI FJ GH GN GQ GT GW GY HN HR HT ID IN IQ IS KE KI KR KZ LR LT LV MD MG MH MK ML MM MT MU MV MW MZ NA NE NI NR PA PE PH PL PW PY RS RW SC SD SG SI SL SM SN SR SS SV TD TJ TN TR TT UG UZ VU YE ZA ZM ZW",
    "Kingdom of": "BE BH BT DK ES KH LS MA NL NO SA SE SZ TH TO",
    "State of": "ER IL KW PS QA",
    "Islamic Republic of": "AF GM IR MR PK",
    "Democratic Republic of": "CD ST TL",
    "People's Republic of": "BD CN",
    "People's Democratic Republic of": "DZ",
    "Federal Republic of": "DE SO",
    "Federative Republic of": "BR",
    "Federal Democratic Republic of": "ET",
    "Socialist Republic of": "VN",
    "Bolivarian Republic of": "VE",
    "Plurinational State of": "BO",
    "United Republic of": "TZ",
    "Principality of": "AD LI MC",
    "Grand Duchy of": "LU",
    "Sultanate of": "OM",
    "Commonwealth of": "AU BS DM",
    "Union of": "KM",
    "Independent State of": "PG WS",
}


def cleaned(name: str) -> str:
    """A name as a key: capital letters and digits, one space for all else."""
    return " ".join(re.sub("[^A-Z0-9]+", " ", name.upper()).split())


def spellings(name: str) -> set[str]:
    """Keys of a name: as it is, and with its letters' marks taken off."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return {cleaned(name), cleaned(plain), cleaned(plain.replace("ı", "i"))} - {""}


def other_keys(known: dict[str, set[str]]) -> dict[str, str]:
    """Keys of other names and official forms by code, for countries whose names are ``known`` by code; codes that it lacks are left out.

    A name of one country is never given to another: what ``known`` has stays, and a form gives way to a name."""
    names = {code: set(n) for code, n in known.items()}
    for line in OTHER_NAMES.strip().splitlines():
        code, listed = line.split(" ", 1)
        if code in names:
            names[code] |= {n.strip() for n in listed.split(";")}
    out: dict[str, str] = {}
    for code, each in names.items():
        for n in each:
            for k in spellings(n):
                out.setdefault(k, code)
    for form, codes in FORMS.items():
        for code in codes.split():
            for n in sorted(names.get(code, ())):
                for link in ("", "the "):
                    for k in spellings(f"{form} {link}{n}"):
                        out.setdefault(k, code)
    return out
