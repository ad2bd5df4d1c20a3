"""The document model: element types, key orders and Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the format.
ELEMENT_TYPES = (
    "heading", "paragraph", "list", "table", "formula", "code", "image", "caption", "footnote", "form_field",
    "annotation", "redaction", "noise", "message", "utterance", "record", "citation", "quote", "toc", "group",
)
SUBTYPES = {
    "image": ("logo", "stamp", "signature", "chart", "diagram", "photo", "qr_code", "barcode"),
    "noise": ("header", "footer", "watermark", "page_number"),
    "group": ("slide", "sidebar", "figure", "box", "sheet", "thread"),
}
PROTECTIONS = ("none", "password", "certificate", "drm")
NEVER_EMBEDDED = ("noise", "toc", "redaction")
ATTACHABLE = ("caption", "footnote")
#: Types whose continued parts are one running text.
RUNNING_TEXT = ("paragraph", "quote", "caption", "footnote", "message", "utterance")
HEADER_KEYS = (
    "type", "version", "doc", "source", "sha256", "protection", "signed", "converter", "structure", "elements",
    "created", "lang", "access", "title", "authors", "date", "summary", "last_id", "meta",
)
HEADER_REQUIRED = HEADER_KEYS[:13]
ELEMENT_KEYS = (
    "id", "hash", "type", "subtype", "level", "label", "parent", "page", "pages", "bbox", "characters", "reference",
    "continues", "confidence", "lang", "access", "html", "latex", "file", "meta", "md",
)
ELEMENT_REQUIRED = ("id", "hash", "type", "parent", "characters", "md")
VERSION = "1.1"
KNOWN_VERSIONS = ("0.1", "0.2", "0.3", "0.4", "0.5", "1.0", "1.1")

ID = r"^[a-z0-9_-]+#e[1-9][0-9]*$"
LABEL = r"^[a-z][a-z0-9_-]*$"
LANG = r"^[a-z]{2,3}(-[A-Za-z0-9]+)*$"
ACCESS = r"^[A-Za-z0-9_.:-]+$"
CREATED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
DATE = r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$"
FILE = r"^images/[^/]+\.(png|webp|jpg|jpeg|svg)$"
LINK = r"\]\(#([a-z0-9_-]+)\)"
#: White space as the format strips it, as a Java and Python character class.
WHITE = r"[\x09-\x0D\x1C-\x20\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: The same characters one by one.
WHITE_CHARACTERS = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

_STRINGS, _INTS = T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


HEADER_SCHEMA = _struct(
    type=T.StringType(), version=T.StringType(), doc=T.StringType(), source=T.StringType(), sha256=T.StringType(), protection=T.StringType(), signed=T.BooleanType(), converter=T.StringType(),
    structure=T.BooleanType(), elements=T.LongType(), created=T.StringType(), lang=T.StringType(), access=_STRINGS, title=T.StringType(), authors=_STRINGS, date=T.StringType(), summary=T.StringType(),
    last_id=T.LongType(), meta=T.StringType(),
)
ELEMENT_SCHEMA = _struct(
    id=T.StringType(), hash=T.StringType(), type=T.StringType(), subtype=T.StringType(), level=T.IntegerType(), label=T.StringType(), parent=T.StringType(), page=T.IntegerType(), pages=_INTS, bbox=_INTS,
    characters=T.LongType(), reference=T.StringType(), continues=T.StringType(), confidence=T.DoubleType(), lang=T.StringType(), access=_STRINGS, html=T.StringType(), latex=T.StringType(),
    file=T.StringType(), meta=T.StringType(), md=T.StringType(),
)
