"""Text measures, cleaning and file-name rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Unicode calls white space, spelled out: Java's \s is ASCII only.
SPACE = r"\s\p{Z}\x{1c}-\x{1f}\x{85}"
WORD_CHAR = r"\p{L}\p{N}_"
TOKEN = f"[{WORD_CHAR}]+|[^{WORD_CHAR}{SPACE}]"
UNPRINTABLE = r"[<>]|[\p{C}\p{Z}&&[^ \n\r\t]]"

# Extensions by file class, and the names kept from an archive.
CODE_EXTENSIONS = ("js", "html", "css", "json", "ts", "jsx", "tsx")
ARCHIVE_EXTENSIONS = (
    "txt", "py", "js", "html", "css", "json", "md", "xml", "csv", "docx", "pdf", "c", "cpp", "java",
)
# The extensions that the mimetypes module of Python 3.13 maps to text/*.
TEXT_MIME_EXTENSIONS = (
    "bat", "c", "css", "csv", "etx", "h", "htm", "html", "js", "ksh", "markdown", "md", "mjs", "n3", "pl", "py", "rst",
    "rtf", "rtx", "sgm", "sgml", "srt", "tsv", "txt", "vcf", "vtt", "xml",
)
ARCHIVE_MEMBER_LIMIT = 10 * 1024 * 1024


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def sanitize(text: Column) -> Column:
    """Drop angle brackets and every unprintable character but newline, return and tab."""
    return F.regexp_replace(text, UNPRINTABLE, "")


def strip(text: Column) -> Column:
    """Trim Unicode white space on both sides (``trim`` takes off spaces only)."""
    return F.regexp_replace(text, f"^[{SPACE}]++|(?<![{SPACE}])[{SPACE}]++\\z", "")


def token_count(text: Column) -> Column:
    """Words plus single punctuation marks; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))


def content_hash(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def line_count(text: Column) -> Column:
    return (F.regexp_count(text, F.lit("\n")) + 1).cast("bigint")


def char_count(text: Column) -> Column:
    return F.length(text).cast("bigint")


def definition_count(text: Column, keyword: str) -> Column:
    """Lines that open a ``class`` or ``def``. The d flag makes only \\n end a line.

    The indent stays within its line, so that blank lines are not gone over again
    from each of them.
    """
    pattern = f"(?md)^[{SPACE}&&[^\\n]]*+{keyword}[{SPACE}]+[{WORD_CHAR}]+"
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def extension(filename: Column) -> Column:
    """Lower-cased part after the last dot, '' if there is no dot."""
    lowered = F.lower(filename)
    return F.when(F.contains(lowered, F.lit(".")), F.substring_index(lowered, ".", -1)).otherwise("")


def file_type(filename: Column, archives: bool = True) -> Column:
    """pdf, docx, excel, py, code, zip or txt. Uploads have no zip class: ``archives=False``."""
    ext = extension(filename)
    kind = (
        F.when(ext == "pdf", "pdf")
        .when(ext.isin("doc", "docx"), "docx")
        .when(ext.isin("xls", "xlsx"), "excel")
        .when(ext == "py", "py")
        .when(ext.isin(*CODE_EXTENSIONS), "code")
    )
    if archives:
        kind = kind.when(ext == "zip", "zip")
    return kind.otherwise("txt")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def member_type(path: Column) -> Column:
    """Route of an archive member: spreadsheets and archives inside are read as text."""
    kind = file_type(base_name(path), archives=False)
    return F.when(kind == "excel", "txt").otherwise(kind)


def member_is_text(path: Column) -> Column:
    """A text MIME guess (also behind a compression suffix), or a listed extension."""
    name = base_name(path)
    guessed = f"[^.].*\\.(?i:{'|'.join(TEXT_MIME_EXTENSIONS)})(\\.(gz|Z|bz2|xz|br))?\\z"
    listed = f"(?i)\\.({'|'.join(ARCHIVE_EXTENSIONS)})\\z"
    return name.rlike(guessed) | name.rlike(listed)


def preview(text: Column, limit: int = 5000) -> Column:
    """The display preview: long text is cut for showing, never for processing."""
    cut = F.concat(F.substring(text, 1, limit), F.lit("... (truncated)"))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def fixed_text(value: Column, digits: int) -> Column:
    """Decimal text rounded on the exact binary value, ties to even.

    Java's ``%.1f`` rounds the shortest decimal form half up, so 1.15 (which is
    stored a little lower) would come out as 1.2. The distance to the midpoint is
    taken in two exact halves instead: the float part and the rest.
    """
    scale = 10**digits
    low = F.floor(value * scale)
    coarse = value.cast("float").cast("double")
    past_middle = (coarse * (2 * scale) - (2 * low + 1)) + (value - coarse) * (2 * scale)
    units = F.when(past_middle > 0, low + 1).when(past_middle < 0, low).otherwise(low + F.abs(low % 2))
    return F.format_string(f"%.{digits}f", units / F.lit(float(scale)))


def grouped_digits(number: Column) -> Column:
    """Integer text with thousands separators."""
    return F.format_number(number, 0)
