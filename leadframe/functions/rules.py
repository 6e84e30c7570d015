"""Ordered rule tables. The order matters wherever the first match wins; all of these are fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field

# Headings that announce pin information, first match wins.
HEADING_PATTERNS = [
    r"pin\s*(?:configuration|out|description|mapping|definition)s?\b",
    r"pinout\b",
    r"pin\s*assignments?\b",
    r"mechanical\s*data\b",
    r"package\s*(?:information|drawing|specification)s?\b",
    r"pin\s*functions?\b",
]

# Column headings of pin tables; two are needed.
TABLE_PATTERNS = [
    r"pin\s*\.?\s*(no\.|number|#)",
    r"pin\s*\.?\s*name",
    r"function",
    r"description",
    r"signal\s*name",
    r"symbol",
]

# Counted as plain text, the last but two too.
DENSITY_KEYWORDS = [
    "pin", "vcc", "vdd", "gnd", "gpio", "pwm", "i2c", "spi", "uart", "rx", "tx", "adc", "dac", "reset",
    "enable", "clock", "oscillator", "input", "output", "power", "ground", "analog", "digital", "interrupt",
    "nc", r"no\s*connect", "vss", "vee",
]

# Captions of diagrams, first match wins.
CAPTION_PATTERNS = [r"pinout", r"pin\s*configuration", r"pin\s*diagram", r"package\s*drawing", r"mechanical\s*drawing"]

# Words that an image page's text is searched for, in the order of the report.
IMAGE_KEYWORDS = ["pinout", "pin configuration", "pin diagram", "package drawing", "mechanical drawing", "package information"]
FIGURE_PATTERN = r"figure\s+\d+[\-\.]?\d*"

# Words that make a header row one of a pin table; repeated and nested entries count as often as they stand here.
TABLE_KEYWORDS = [
    "pin", "no.", "number", "num", "#", "name", "function", "description", "desc", "signal", "io", "power", "ground",
    "vcc", "vdd", "gnd", "vss", "reset", "clock", "oscillator", "xtal", "xtal", "crystal", "adc", "dac", "pwm", "spi",
    "i2c", "uart", "usart", "pa", "pb", "pc", "pd", "pe", "pf",
]
CANDIDATE_TABLE_WORDS = ["pin", "no.", "name", "function", "description"]

# Fixed values. The list has each word once: it is asked whether any of them occurs, so repeats wouldn't change a result.
SECTION_KEYWORDS = [
    "pinout", "pin configuration", "pin description", "pin mapping", "pin names", "pin functions", "pin assignments",
    "pin details", "package pinout", "component pinout", "device pinout", "pin diagram", "package drawing",
    "mechanical drawing", "pindescription", "pindefinitions", "pin definition", "pin table", "pin list", "pinout table",
]
# Phrases that alone make a text one about pins.
STRONG_PHRASES = ["pinout -", "figure 1-1. pinout", "figure 1-2. pinout", "figure 1-3. pinout", "pin configurations", "pin mapping"]
STRONG_HEADINGS = ["pinout -", "figure 1-1. pinout", "figure 1-2. pinout", "figure 1-3. pinout", "pin configurations"]
# Phrases that speak against it, between spaces or at the end.
EXCLUSIONS = [
    "absolute maximum", "absolute minimum", "electrical characteristics", "recommended operating conditions",
    "thermal information", "ordering information", "packaging information",
]
DIAGRAM_LINE = r"\([a-z0-9]+/[a-z0-9]+/[a-z0-9]+/t?\d*\)\s*[a-z]+\d+\s+[a-z]+\d+\s*\("

# Package types in the order in which they are tried.
PACKAGE_PATTERNS = [
    ("DIP", [r"dip\s*\d*", r"dual\s*in\s*line", r"pdip", r"cerdip", r"spdip"]),
    ("QFN", [r"qfn", r"quad\s*flat\s*no[-\s]?lead", r"vqfn", r"uqfn", r"dfn"]),
    ("SOIC", [r"soic", r"small\s*outline[-\s]?ic", r"sop", r"ssop", r"msop"]),
    ("TSSOP", [r"tssop", r"thin\s*shrink\s*small\s*outline"]),
    ("BGA", [r"bga", r"ball\s*grid\s*array", r"lfbga", r"fbga"]),
    ("LGA", [r"lga", r"land\s*grid\s*array"]),
    ("TQFP", [r"tqfp", r"thin\s*quad\s*flat\s*pack"]),
]
# Names as they occur in package texts and their common form, first contained wins, so the order counts.
NAME_ALIASES = [
    ("DIL", "DIP"), ("DUAL INLINE", "DIP"), ("PDIP", "DIP"), ("VQFN", "QFN"), ("UQFN", "QFN"), ("DFN", "QFN"),
    ("SOP", "SOIC"), ("SSOP", "SOIC"), ("MSOP", "SOIC"), ("TQFP", "QFP"), ("LFBGA", "BGA"),
]
# Names of the types that have a geometry; whole names first, then prefixes in this order.
TYPE_ALIASES = [
    ("DIP", "DIP"), ("PDIP", "DIP"), ("CDIP", "DIP"), ("SOIC", "SOIC"), ("SOP", "SOIC"), ("SSOP", "SOIC"),
    ("TSOP", "SOIC"), ("TQFP", "TQFP"), ("LQFP", "LQFP"), ("QFP", "TQFP"), ("QFN", "QFN"), ("DFN", "QFN"),
    ("BGA", "BGA"), ("LGA", "BGA"),
]

# (type, lowest and highest pin count, width from, to, height from, to) in mm; beyond the last bucket it still holds.
MANY = 2147483647
DIMENSIONS = [
    ("DIP", -MANY, 20, 4.0, 10.0, 6.0, 10.0),
    ("DIP", 21, 48, 8.0, 12.0, 10.0, 18.0),
    ("DIP", 49, MANY, 10.0, 15.0, 18.0, 30.0),
    ("QFN", -MANY, 20, 3.0, 6.0, 3.0, 6.0),
    ("QFN", 21, 48, 4.0, 8.0, 4.0, 8.0),
    ("QFN", 49, MANY, 6.0, 12.0, 6.0, 12.0),
    ("SOIC", -MANY, 20, 4.0, 7.0, 6.0, 10.0),
    ("SOIC", 21, MANY, 5.0, 8.0, 8.0, 15.0),
    ("TSSOP", -MANY, 20, 3.0, 5.0, 4.0, 8.0),
    ("TSSOP", 21, MANY, 4.0, 6.5, 6.0, 12.0),
]
# Pin counts that occur with a package type.
QFN_PINS = [8, 16, 20, 24, 32, 48, 64]
DIP_PINS = [4, 6, 8, 14, 16, 18, 20, 24, 28, 40, 64]
SOIC_PINS = [8, 14, 16, 20, 24, 28]
TSSOP_PINS = [8, 14, 16, 20, 24, 28, 32, 48]

# Fixed values, as drawings have to agree to the digit. Geometry that depends on the package type alone:
# (type, pitch, top margin, name offset, number offset, leg length, leg width, leg thickness, number size, name size,
#  name height, number height, border thickness, border height, designator size, designator offset, value size, value offset)
GEOMETRY = [
    ("DIP", 2.50, 5.0, 12.0, 2.0, 2.0, 0.15, 0.5, 1.0, 1.5, 0.5, 0.5, 0.25, 0.5, 3.0, 6.0, 1.5, 2.5),
    ("SOIC", 1.27, 5.0, 6.0, 2.0, 4.0, 0.1, 0.5, 1.0, 1.5, 0.5, 0.5, 0.5, 0.5, 4.0, 8.0, 2.0, 3.0),
    ("TQFP", 0.5, 4.0, 4.0, 2.0, 3.0, 0.1, 0.3, 1.0, 1.0, 0.3, 0.3, 0.3, 0.3, 3.0, 5.0, 2.0, 3.0),
    ("QFN", 0.5, 3.0, 3.5, 2.0, 2.0, 0.1, 0.5, 1.0, 1.5, 0.5, 0.5, 0.5, 0.5, 4.0, 8.0, 2.0, 3.0),
    ("BGA", 1.0, 3.0, 6.0, 2.0, 1.5, 0.3, 0.3, 0.8, 1.2, 0.5, 0.5, 0.5, 0.5, 4.0, 8.0, 2.0, 3.0),
]
GEOMETRY_COLUMNS = [
    "pitch", "top_margin", "name_offset", "num_offset", "leg_length", "leg_width", "leg_thickness", "num_size", "name_size",
    "name_height", "num_height", "border_thickness", "border_height", "designator_size", "designator_offset", "value_size",
    "value_offset",
]

# Words in a section's name and the side they mean, first match wins; without any it is the left.
SIDE_WORDS = ["left", "right", "top", "bottom"]

# Package words of a layout answer, in the order in which they are tried.
LAYOUT_PACKAGES = [
    ("DIP", ["DIP", "Dual Inline"]),
    ("QFN", ["QFN", "Quad Flat"]),
    ("TQFP", ["TQFP", "Thin Quad Flat"]),
    ("LQFP", ["LQFP", "Low-profile Quad Flat"]),
    ("BGA", ["BGA", "Ball Grid Array"]),
    ("SOIC", ["SOIC", "Small Outline"]),
    ("Grid", ["Grid", "Column", "Layout"]),
]

# Fixed values, as results are compared with them. Known parts: (name, pins, names that have to occur).
KNOWN_PINOUTS = [
    ("ATmega164A", 40, ["VCC", "GND", "RESET", "XTAL1", "XTAL2"]),
    ("NE555", 8, ["VCC", "GND", "TRIGGER", "OUTPUT", "RESET", "CONTROL VOLTAGE", "THRESHOLD", "DISCHARGE"]),
]
ERROR_STATUSES = ["error", "extraction_error", "llm_error"]


@dataclass(frozen=True)
class PageRules:
    """What pages are scored by; a caller may bring other lists. Patterns are for lower-cased text, and their order counts."""

    headings: list[str] = field(default_factory=lambda: HEADING_PATTERNS)
    tables: list[str] = field(default_factory=lambda: TABLE_PATTERNS)
    captions: list[str] = field(default_factory=lambda: CAPTION_PATTERNS)
    keywords: list[str] = field(default_factory=lambda: DENSITY_KEYWORDS)


PAGE_RULES = PageRules()
