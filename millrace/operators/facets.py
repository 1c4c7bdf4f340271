"""Facets: counts of attributes, what is shown of them, file types, and first of equal results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(attributes: DataFrame) -> DataFrame:
    """key, value, n: of long attributes (key, value); a null value is the key's total."""
    return attributes.groupingSets([["key", "value"], ["key"]], "key", "value").agg(F.count("*").alias("n"))


def shown(counted: DataFrame, most: int, order: str = "hits", hidden: Sequence[str] = (), empty: bool = False, reverse: bool = False) -> DataFrame:
    """key, value, n, place: up to `most` values of each key, by hits or by name, without the hidden ones."""
    rows = counted.where(F.col("value").isNotNull() & ~F.col("value").isin(*hidden)) if hidden else counted.where("value is not null")
    rows = rows if empty else rows.where("n > 0")
    by = [F.col("value")] if order == "alpha" else [F.col("n").desc(), F.col("value")]
    if reverse:
        by = [F.col("value").desc()] if order == "alpha" else [F.col("n"), F.col("value")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*by)).cast("long")).where(F.col("place") <= most)


def first_of_equal(rows: DataFrame, key: Column | str, *order: Column) -> DataFrame:
    """The best row of each key. WindowGroupLimit keeps the first of each key in every task, so no key is sorted in one."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_place = 1").drop("_place")


# File name extensions with their group, name, name in Norwegian, version and icon
FILE_TYPES = [
    ("doc", "Word", "Document", "Dokument", "97-2003", "doc"),
    ("dot", "Word", "Document Template", "Utformingsmal", "97-2003", "dot"),
    ("docx", "Word", "Document", "Dokument", "2007", "docx"),
    ("dotx", "Word", "Document Template", "Utformingsmal", "2007", None),
    ("docm", "Word", "Macro-enabled Document", "Makroaktivert dokument", "2007", None),
    ("dotm", "Word", "Macro-enabled Document Template", "Makroaktivert utformingsmal", "2007", None),
    ("rtf", "Word", "Rich Text Format", "Rik tekst-dokument", None, "rtf"),
    ("pps", "PowerPoint", "Slide Show", "Fremvisning", "97-2003", "pps"),
    ("ppt", "PowerPoint", "Presentation", "Presentasjon", "97-2003", "ppt"),
    ("pot", "PowerPoint", "Presentation Template", "Utformingsmal", "97-2003", "ppt"),
    ("pptx", "PowerPoint", "Presentation", "Presentasjon", "2007", "pptx"),
    ("pptm", "PowerPoint", "Macro-enabled Presentation", "Makroaktivert presentasjon", "2007", None),
    ("potx", "PowerPoint", "Presentation Template", "Utformingsmal", "2007", None),
    ("potm", "PowerPoint", "Macro-enabled Presentation Template", "Makroaktivert utformingsmal", "2007", None),
    ("ppam", "PowerPoint", "Macro-enabled Add-in", "Makroaktivert tillegg", "2007", None),
    ("ppsx", "PowerPoint", "Slide Show", "Fremvisning", "2007", None),
    ("ppsm", "PowerPoint", "Macro-enabled Slide Show", "Makroaktivert fremvisning", "2007", None),
    ("xls", "Excel", "Workbook", "Arbeidsbok", "97-2003", "xls"),
    ("xlt", "Excel", "Template", "Utformingsmal", "97-2003", "xls"),
    ("xlsx", "Excel", "Workbook", "Arbeidsbok", "2007", "xlsx"),
    ("xlsm", "Excel", "Macro-enabled Workbook", "Makroaktivert arbeidsbok", "2007", None),
    ("xltx", "Excel", "Template", "Utformingsmal", "2007", None),
    ("xltm", "Excel", "Macro-enabled Workbook Template", "Makroaktivert utformingsmal", "2007", None),
    ("xlsb", "Excel", "Binary Workbook", "Binær arbeidsbok", "2007", None),
    ("xlam", "Excel", "Macro-enabled Add-in", "Makroaktivert tillegg", "2007", None),
    ("odp", "OpenOffice", "Presentation", "Presentasjon", None, None),
    ("otp", "OpenOffice", "Presentation Template", "Presentasjonsmal", None, None),
    ("ods", "OpenOffice", "Spreadsheet", "Regneark", None, None),
    ("ots", "OpenOffice", "Spreadsheet Template", "Regnearkmal", None, None),
    ("odt", "OpenOffice", "Document", "Dokument", None, None),
    ("ott", "OpenOffice", "Document Template", "Dokumentmal", None, None),
    ("sdw", "OpenOffice", "StarOffice Document", "StarOffice-dokument", "5.0", None),
    ("pdf", "Adobe PDF", "Document", "Dokument", None, None),
    ("abw", "AbiWord", "Document", "Dokument", None, None),
    ("wpf", "Word Perfect", "Document", "Dokument", None, None),
    ("eml", "E-mail", "E-mail (eml)", "E-post (eml)", None, "eml"),
    ("msg", "E-mail", "E-mail (msg)", "E-post (msg)", None, "msg"),
    ("htm", "Webpage", "HTML Document", "HTML-dokument", None, None),
    ("html", "Webpage", "HTML Document", "HTML-dokument", None, None),
    ("txt", "Notepad", "Text Document", "Tekst-dokument", None, None),
    ("jpg", "Image", "JPEG Image", "JPEG-bilde", None, "jpg"),
    ("jpeg", "Image", "JPEG Image", "JPEG-bilde", None, "jpg"),
    ("png", "Image", "PNG Image", "PNG-bilde", None, "png"),
    ("psd", "Image", "Photoshop", "Photoshop", None, "psd"),
    ("gif", "Image", "GIF Image", "GIF-bilde", None, "gif"),
    ("tif", "Image", "Adobe TIFF Image", "Adobe TIFF-bilde", None, "tiff"),
    ("tiff", "Image", "Adobe TIFF Image", "Adobe TIFF-bilde", None, "tiff"),
    ("bmp", "Image", "BMP Image", "BMP-bilde", None, "bmp"),
    ("eps", "Image", "Encapsulated PostScript", "Innkapslet PostScript", None, "eps"),
    ("ai", "Image", "Adobe Illustrator", "Adobe Illustrator", None, "ai"),
    ("mp3", "Audio", "MP3 Audio", "MP3-lydfil", None, None),
    ("dwg", "AutoCAD", "AutoCAD", "AutoCAD", None, None),
    ("zip", "Archive", "ZIP Archive", "ZIP-arkiv", None, None),
    ("tapp", "Application Data", "Application data", "Program data", None, None),
]
# Icons of groups, and names of groups in Norwegian where they differ
GROUP_ICONS = {"Word": "docx", "PowerPoint": "pptx", "Excel": "xlsx", "OpenOffice": "txt", "Adobe PDF": "pdf", "AbiWord": "txt", "Word Perfect": "txt", "E-mail": "mail", "Webpage": "html", "Notepad": "txt", "Image": "jpg", "Audio": "mp3", "AutoCAD": "dwg", "Archive": "zip", "Application Data": "tapp"}
GROUPS_NBO = {"E-mail": "E-post", "Webpage": "Webside", "Image": "Bilde", "Audio": "Lydfil", "Archive": "Arkiv", "Other": "Annet"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_type(ext: Column, language: str = "eng") -> Column:
    """struct(group, name, version, icon) of an extension, in English (eng) or Norwegian (nbo); the group Other if unknown."""
    nbo = language == "nbo"
    group = lambda g: GROUPS_NBO.get(g, g) if nbo else g
    made = lambda g, name, version, icon: F.struct(*(F.lit(v).cast("string").alias(k) for k, v in (("group", group(g)), ("name", name), ("version", version), ("icon", icon))))
    known = [x for e, g, name, other, version, icon in FILE_TYPES for x in (F.lit(e), made(g, other if nbo else name, version, icon or GROUP_ICONS[g]))]
    return F.coalesce(F.element_at(F.create_map(*known), ext), made("Other", None, None, "default"))


def file_group(ext: Column) -> Column:
    """The group of an extension, Other if unknown."""
    return file_type(ext)["group"]


def navigation(counted: DataFrame, rules: Sequence[dict], attributes: Sequence[str] = ()) -> DataFrame:
    """place, group, key, value, n, expanded, level of what display rules show of counts (key, value, n).

    A rule shows values of `select`: "k" the values of an attribute, "k/*" the values of all whose names begin with k and a
    slash. `hide` leaves values out, `group` is a heading over the rule's values with their sum, `import` takes the rules
    of another, by name. `expanded` opens a heading; `show_empty` keeps values that count nothing; `show_max` bounds the
    values of an attribute, `show_max_sub` those below a heading; `sort` is none (as counted, by value), hits or alpha,
    turned round by `reverse`.
    """
    by_name = {r["name"]: r for r in rules if r.get("name")}
    out = None
    flat = [{**by_name[r["import"]], **{k: v for k, v in r.items() if k != "import"}} if r.get("import") in by_name else r for r in rules]
    for place, rule in enumerate(flat):
        key = rule["select"]
        own = F.col("key").startswith(key[:-1]) if key.endswith("/*") else F.col("key") == key
        rows = counted.where(own & F.col("value").isNotNull() & ~F.col("value").isin(*rule.get("hide", ["\0"])))
        rows = rows if rule.get("show_empty") else rows.where("n > 0")
        turn = (lambda c: c.desc()) if rule.get("reverse") else (lambda c: c.asc())
        by = {"alpha": [turn(F.col("value"))], "hits": [turn(-F.col("n")), F.col("value")]}.get(rule.get("sort", "none"), [turn(F.col("key")), F.col("value")])
        most = rule.get("show_max_sub" if rule.get("group") else "show_max", rule.get("show_max"))
        if most is not None:
            rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("key").orderBy(*by))).where(F.col("_k") <= most).drop("_k")
        group, open_ = F.lit(rule.get("group")).cast("string"), F.lit(bool(rule.get("expanded")))
        shown_ = rows.select(F.lit(place).alias("place"), group.alias("group"), "key", "value", "n", open_.alias("expanded"), F.lit(1 if rule.get("group") else 0).alias("level"))
        if rule.get("group"):
            head = rows.agg(F.sum("n").alias("n")).where("n is not null").select(F.lit(place).alias("place"), group.alias("group"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), "n", open_.alias("expanded"), F.lit(0).alias("level"))
            shown_ = head.unionByName(shown_)
        out = shown_ if out is None else out.unionByName(shown_)
    return out
