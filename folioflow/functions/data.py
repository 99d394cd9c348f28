"""Fixed vocabularies that results have to agree on: the classification's labels and keywords, kinds of files, generic names, months."""

from __future__ import annotations

_LABELS = """
000 Computer Science & Information
100 Philosophy & Psychology
200 Religion
300 Social Sciences
400 Language
500 Science
600 Technology
610 Medicine & Health
630 Agriculture
636 Animal Husbandry
636.1 Horses & Equines
636.7 Dogs
636.8 Cats
700 Arts & Recreation
800 Literature
900 History & Geography
"""
#: Code -> label.
TAXONOMY = dict(line.split(" ", 1) for line in _LABELS.strip().splitlines())
#: Ordered rules: the first whose words occur anywhere, inside other words too, decides.
KEYWORDS = tuple(
    (code, tuple(words.split()))
    for code, words in (("636.1", "horse equine colt mare stallion"), ("000", "software programming computer algorithm"), ("610", "medicine health doctor disease"), ("800", "writing literature novel poetry"))
)
#: Extension -> kind of document.
KINDS = {
    extension: kind
    for kind, extensions in (("PDF Document", "pdf"), ("Word Document", "docx doc"), ("Markdown Document", "md markdown"), ("Text Document", "txt"), ("Transcript", "srt vtt"), ("Scanned Image", "png jpg jpeg tif tiff"))
    for extension in extensions.split()
}
#: Words of file names that tell nothing.
GENERIC_STEMS = tuple("copy document documents download downloads draft file files final new report reports scan scanned untitled".split())
MONTHS = tuple("jan feb mar apr may jun jul aug sep oct nov dec".split())
#: What may follow the three letters of a month.
MONTH_ENDINGS = ("uary", "ruary", "ch", "il", "", "e", "y", "ust", "tember", "ober", "ember", "ember")
ABBREVIATIONS = frozenset(f"{a}." for a in "mr mrs ms dr prof sr jr st vs etc e.g i.e cf no fig approx avg inc ltd corp dept gov gen col capt adm sen rep rev hon sec asst adj".split())
