"""Text functions as native column expressions; pandas only where the JVM has none."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Frequent English words that say nothing about a topic.
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further "
    "had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such "
    "than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your"
).split()


def md5_id(col: Column, prefix: str = "") -> Column:
    """``prefix`` and the lower-case md5 of the UTF-8 text."""
    return F.concat(F.lit(prefix), F.md5(col.cast("binary")))


def strip_tags(col: Column) -> Column:
    """Without ``<...>``; a tag that goes over a line end stays."""
    return F.regexp_replace(col, "<.*?>", "")


def strip(col: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def non_blank(col: Column) -> Column:
    return F.coalesce(strip(col) != "", F.lit(False))


def window(col: Column, size: int) -> Column:
    """The first ``size`` characters after stripping."""
    return F.substring(strip(col), 1, size)


def blank_split(col: Column) -> Column:
    return F.filter(F.split(col, r"(?U)\s+"), lambda x: x != "")


def last_of(col: Column, sep: str) -> Column:
    """What follows the last ``sep``."""
    return F.try_element_at(F.split(col, sep, -1), F.lit(-1))


def extract(col: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(F.regexp_like(col, F.lit(pattern)), F.regexp_extract(col, pattern, group))


def long_date(col: Column) -> Column:
    """``4 July 2012`` as a date, null if it is none."""
    return F.try_to_timestamp(col, F.lit("d MMMM yyyy")).cast("date")


def clean_tokens(col: Column, stop: list[str] | tuple[str, ...] = tuple(STOP_WORDS)) -> Column:
    """Distinct lower-case words of letters without stop words; cleaning twice changes nothing."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(r"([\p{L}]+)"), F.lit(1))
    return F.array_except(words, F.array(*[F.lit(w) for w in stop]).cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays without repeats; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


def first_max(values: Column) -> Column:
    """Place, from 0, of the first of the largest values."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def nfkd(col: Column | str) -> Column:
    """Compatibility decomposition, for which the JVM has no function."""

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))

    return run(col)


#: Words by which a text gives its language away.
LANGUAGE_WORDS = {
    "en": "the of and to is that was for with this are from not have",
    "fr": "le la les des et est une dans pour que qui sur pas avec",
    "de": "der die das und ist nicht mit den von ein eine für auf sich",
    "es": "el los las de que en una por con para del es no como",
    "pt": "os das não uma com para por mais como mas foi ao dos são",
    "it": "il di che non una per con del sono della gli più anche nel",
    "nl": "de het een van en niet dat op zijn met voor aan ook bij",
}


def detect_language(col: Column) -> Column:
    """The language with the most frequent words that a text has; null if it has none."""
    words = F.split(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}]+")
    votes = [F.struct(F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in ws]))).alias("n"), F.lit(-k).alias("rank"), F.lit(lang).alias("lang")) for k, (lang, ws) in enumerate((a, b.split()) for a, b in LANGUAGE_WORDS.items())]
    best = F.array_max(F.array(*votes))
    return F.when(best["n"] > 0, best["lang"])


#: ISO 639-1 codes and English names.
_NAMED = """
ab Abkhazian|aa Afar|af Afrikaans|ak Akan|sq Albanian|am Amharic|ar Arabic|an Aragonese|hy Armenian|as Assamese|av Avaric|ay Aymara|az Azerbaijani|bm Bambara|ba Bashkir|eu Basque
be Belarusian|bn Bangla|bi Bislama|bs Bosnian|br Breton|bg Bulgarian|my Burmese|ca Catalan|ch Chamorro|ce Chechen|ny Nyanja|zh Chinese|cv Chuvash|kw Cornish|co Corsican|cr Cree
hr Croatian|cs Czech|da Danish|dv Divehi|nl Dutch|dz Dzongkha|en English|eo Esperanto|et Estonian|ee Ewe|fo Faroese|fj Fijian|fi Finnish|fr French|ff Fula|gl Galician
ka Georgian|de German|el Greek|gn Guarani|gu Gujarati|ht Haitian Creole|ha Hausa|he Hebrew|hz Herero|hi Hindi|ho Hiri Motu|hu Hungarian|ia Interlingua|id Indonesian|ie Interlingue|ga Irish
ig Igbo|ik Inupiaq|io Ido|is Icelandic|it Italian|iu Inuktitut|ja Japanese|jv Javanese|kl Kalaallisut|kn Kannada|kr Kanuri|ks Kashmiri|kk Kazakh|km Khmer|ki Kikuyu|rw Kinyarwanda
ky Kyrgyz|kv Komi|kg Kongo|ko Korean|ku Kurdish|kj Kuanyama|la Latin|lb Luxembourgish|lg Ganda|li Limburgish|ln Lingala|lo Lao|lt Lithuanian|lu Luba-Katanga|lv Latvian|gv Manx
mk Macedonian|mg Malagasy|ms Malay|ml Malayalam|mt Maltese|mi Maori|mr Marathi|mh Marshallese|mn Mongolian|na Nauru|nv Navajo|nd North Ndebele|ne Nepali|ng Ndonga|nb Norwegian Bokmål|nn Norwegian Nynorsk
no Norwegian|ii Sichuan Yi|nr South Ndebele|oc Occitan|oj Ojibwa|cu Church Slavic|om Oromo|or Odia|os Ossetic|pa Punjabi|pi Pali|fa Persian|pl Polish|ps Pashto|pt Portuguese|qu Quechua
rm Romansh|rn Rundi|ro Romanian|ru Russian|sa Sanskrit|sc Sardinian|sd Sindhi|se Northern Sami|sm Samoan|sg Sango|sr Serbian|gd Scottish Gaelic|sn Shona|si Sinhala|sk Slovak|sl Slovenian
so Somali|st Southern Sotho|es Spanish|su Sundanese|sw Swahili|ss Swati|sv Swedish|ta Tamil|te Telugu|tg Tajik|th Thai|ti Tigrinya|bo Tibetan|tk Turkmen|tl Filipino|tn Tswana
to Tongan|tr Turkish|ts Tsonga|tt Tatar|ty Tahitian|ug Uyghur|uk Ukrainian|ur Urdu|uz Uzbek|ve Venda|vi Vietnamese|vo Volapük|wa Walloon|cy Welsh|wo Wolof|fy Western Frisian
xh Xhosa|yi Yiddish|yo Yoruba|za Zhuang|zu Zulu
"""
LANGUAGE_NAMES = dict(x.split(" ", 1) for line in _NAMED.strip().split("\n") for x in line.split("|"))


def language_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.try_element_at(names, code)


def language_code(name: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for k, v in LANGUAGE_NAMES.items() for x in (v.lower(), k)])
    return F.try_element_at(codes, F.lower(name))
