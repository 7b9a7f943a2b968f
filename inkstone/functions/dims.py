"""Small lookup tables of the document format, as DataFrames of a fixed size."""

from __future__ import annotations

import locale

from pyspark.sql import DataFrame, SparkSession

#: Field types by what may stay alive: plain ones, ones whose target is checked, ones that reach outside the document.
LIVE = "= AUTHOR AUTONUM AUTONUMLGL AUTONUMOUT COMMENTS CREATEDATE DATE EDITTIME EQ FILENAME FILESIZE FORMULA INDEX KEYWORDS LASTSAVEDBY NUMCHARS NUMPAGES NUMWORDS PAGE PRINTDATE QUOTE REVNUM SAVEDATE SECTION SECTIONPAGES SUBJECT SYMBOL TA TC TIME TITLE TOA TOC XE".split()
TARGET = "FTNREF HYPERLINK LISTNUM NOTEREF PAGEREF REF SEQ STYLEREF".split()
ACTIVE = "ADDIN CONTROL DDE DDEAUTO EMBED HTMLCONTROL IMPORT INCLUDE INCLUDEPICTURE INCLUDETEXT LINK MACROBUTTON PRINT".split()

def _tag(name: str) -> str:
    """The tag of a locale's name: ``zh_CHS`` is the language of its country, scripts are titled, countries in capitals."""
    parts = {"zh_CHS": "zh_CN", "zh_CHT": "zh_TW"}.get(name, name).split("_")
    return "-".join([parts[0].lower(), *(p.title() if len(p) == 4 else p.upper() for p in parts[1:])])


#: Language identifiers, as the standard library names their locales; 255 is none that documents name.
LANGUAGES = {lid: _tag(name) for lid, name in sorted(locale.windows_locale.items())} | {1: "ar", 255: "zxx"}

#: Number-format codes of lists and page numbers, from 0; a dash is a code that names none.
NUMBER_FORMATS = {
    k: v
    for k, v in enumerate(
        """decimal upperRoman lowerRoman upperLetter lowerLetter ordinal cardinalText ordinalText hex chicago ideographDigital japaneseCounting aiueo iroha decimalFullWidth decimalHalfWidth
        japaneseLegal japaneseDigitalTenThousand decimalEnclosedCircle decimalFullWidth2 aiueoFullWidth irohaFullWidth decimalZero bullet ganada chosung decimalEnclosedFullstop decimalEnclosedParen
        decimalEnclosedCircleChinese ideographEnclosedCircle ideographTraditional ideographZodiac ideographZodiacTraditional taiwaneseCounting ideographLegalTraditional taiwaneseCountingThousand taiwaneseDigital
        chineseCounting chineseLegalSimplified chineseCountingThousand decimal koreanDigital koreanCounting koreanLegal koreanDigital2 hebrew1 arabicAlpha hebrew2 arabicAbjad hindiVowels hindiConsonants
        hindiNumbers hindiCounting thaiLetters thaiNumbers thaiCounting vietnameseCounting numberInDash russianLower russianUpper""".split()
    )
} | {255: "none"}

#: The sixteen palette colours, by index from 1; 0 is automatic.
PALETTE = ("auto", "000000", "0000FF", "00FFFF", "00FF00", "FF00FF", "FF0000", "FFFF00", "FFFFFF", "000080", "008080", "008000", "800080", "800000", "808000", "808080", "C0C0C0")


#: Border styles by code, from 0; a dash is a code that names none.
BORDERS = dict(enumerate("none single - double - single dotted dashed dotDash dotDotDash triple thinThickSmallGap thickThinSmallGap thinThickThinSmallGap thinThickMediumGap thickThinMediumGap thinThickThinMediumGap thinThickLargeGap thickThinLargeGap thinThickThinLargeGap wave doubleWave dashSmallGap dashDotStroked threeDEmboss threeDEngrave outset inset".split()))

#: Shading patterns: those in a row from 0, and the odd ones.
SHADES = dict(enumerate("clear solid pct5 pct10 pct20 pct25 pct30 pct40 pct50 pct60 pct70 pct75 pct80 pct90 horzStripe vertStripe reverseDiagStripe diagStripe horzCross diagCross thinHorzStripe thinVertStripe thinReverseDiagStripe thinDiagStripe thinHorzCross thinDiagCross".split()))
SHADES |= dict(zip((37, 38, 43, 46, 49, 51, 52, 57, 60), (f"pct{n}" for n in (12, 15, 35, 45, 55, 62, 65, 85, 95))))


def field_classes(spark: SparkSession) -> DataFrame:
    rows = [(k, "live") for k in LIVE] + [(k, "target") for k in TARGET] + [(k, "active") for k in ACTIVE]
    return spark.createDataFrame(rows, "kind string, class string")


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANGUAGES.items()), "lid int, tag string")


def number_formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NUMBER_FORMATS.items()), "code int, name string")
