"""Small tables of awkward rows: the inputs of rules that the standard tables do not exercise.

A fixture is a schema and rows; it is a DataFrame for a query and a VALUES clause for its SQL.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]", "timestamp": "TIMESTAMP"}


def sql_value(v: Any) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(sql_value, v)) + "]"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


@dataclass(frozen=True)
class Fixture:
    name: str
    schema: str
    rows: tuple[tuple, ...]

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [tuple(c.split()) for c in self.schema.split(", ")]

    def frame(self, spark: SparkSession) -> DataFrame:
        plain = ", ".join(f"{n} {'string' if t == 'timestamp' else t}" for n, t in self.columns)
        df = spark.createDataFrame([tuple(r) for r in self.rows], plain)
        for n, t in self.columns:
            if t == "timestamp":
                df = df.withColumn(n, df[n].cast("timestamp_ntz"))
        return df

    @property
    def sql(self) -> str:
        """``name AS (SELECT ... FROM (VALUES ...))``, for a WITH clause."""
        names = ", ".join(f'"{n}"' for n, _ in self.columns)
        typed = ", ".join(f'"{n}"::{SQL_TYPES[t]} AS "{n}"' for n, t in self.columns)
        rows = ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in self.rows)
        return f"{self.name} AS (SELECT {typed} FROM (VALUES {rows}) v({names}))"


COURSE_FIELDS = Fixture(
    "course_fields",
    "course_id string, field string, text string",
    (
        ("c1", "title", "Robot sensor calibration"),
        ("c1", "description", "Students calibrate robot sensors in a lab. They also review control methods.\nA second line on archives."),
        ("c2", "title", "Introduction to Robotics"),
        ("c2", "description", "Robots and motion planning; sensors are not covered here"),
        ("c3", "title", "Medieval archives"),
        ("c3", "description", "Choosing sources for medieval history. Historians interpret archival statutes!\n\nInterpretation of archival sources, in depth?  Yes."),
        ("c3", "academic_areas", "History"),
        ("c3", "expertise_tags", "archive interpretation"),
        ("c4", "department", "Control of large and complex and varied engineering structures under loads"),
        ("c4", "description", "Control theory of structures."),
        ("c5", "title", "Calibration"),
        ("c5", "description", "Calibration of scales"),
        ("c6", "title", "Choose well"),
        ("c6", "description", "Selecting the many possible and long discussed but rather different treatments. We choose among treatments."),
        ("c7", "title", "Physical education"),
        ("c7", "description", ""),
        ("c8", "code", "ROB robot sensors calibration"),
        ("c8", "title", "robot"),
        ("c9", "title", "Übung: robot sensors, calibrated"),
        ("c9", "description_variants", "Sensor calibration (robots) and history"),
        ("c9", "description_variants", "Structures: control and more control and yet more of the same and structures"),
        ("c10", "title", "History of control structures"),
        ("c10", "description", "A robot history. Control structures, selected treatments, and archival sources for interpretation"),
        ("c11", "school", "School of Robots"),
        ("c11", "description", "System design and analysis"),
    ),
)

REQUIREMENTS = ("calibrate robot sensors", "robotics", "choose treatments", "interpret archival sources", "control structures", "calibration", "history", "design and analysis")
SEARCH_TERMS = {"calibrate robot sensors": ["robot calibration", "sensor"], "interpret archival sources": ["archival interpretation"]}
CONTEXT = "robot expert"

COURSES = Fixture(
    "course_facts",
    "course_id string, classified string, named_material boolean",
    (
        ("c1", "reviewed", True), ("c2", "reviewed", True), ("c3", "unknown", True), ("c4", "reviewed", True), ("c5", "unknown", True), ("c6", "reviewed", True),
        ("c7", "reviewed", True), ("c8", "unknown", True), ("c9", "unknown", True), ("c10", "unknown", True), ("c11", "reviewed", False),
    ),
)

REVIEWS = Fixture(
    "course_reviews",
    "course_id string, requirement string, decision string, field string, quote string, at int",
    (
        ("c2", "calibrate robot sensors", "reject", "title", "Introduction", 1),
        ("c2", "calibrate robot sensors", "supplemental", "title", "Robotics", 2),
        ("c1", "calibrate robot sensors", "essential", "description", "calibrate robot sensors", 1),
        ("c9", "robotics", "reject", "title", "robot", 3),
        ("c9", "robotics", "reject", "title", "robot sensors", 4),
        ("c10", "history", "essential", "description", "A robot history.", 1),
        ("c3", "history", "essential", "title", "Medieval archives", 1),
        ("c7", "history", "reject", "title", "Physical", 1),
    ),
)

SIMILARITIES = Fixture("similarities", "course_id string, requirement string, similarity double", (("c9", "calibrate robot sensors", 0.75), ("c8", "robotics", 0.5), ("c2", "robotics", 0.25)))

PRIORITIES = Fixture("priorities", "requirement string, priority string", (("calibrate robot sensors", "essential"), ("robotics", "essential"), ("history", "supplemental"), ("control structures", "essential")))

STRENGTH = Fixture(
    "strength",
    "requirement string, course_id string, provider string, year int, subject string, version string, low int, high int",
    (
        ("history", "c3", "qs", 2024, "hist", "v1", 40, 50), ("history", "c10", "qs", 2024, "hist", "v1", 1, 10), ("history", "c3", "the", 2025, "hist", "v2", 1, 1),
        ("control structures", "c4", "qs", 2024, "eng", "v1", 30, 40), ("control structures", "c10", "qs", 2024, "eng", "v1", 20, 30), ("control structures", "c9", "qs", 2024, "eng", "v1", 5, 9),
        ("robotics", "c1", "qs", 2023, "rob", "v1", 9, 12), ("robotics", "c8", "qs", 2023, "rob", "v1", 1, 3), ("robotics", "c2", "qs", 2023, "rob", "v1", 4, 4), ("robotics", "c10", "qs", 2023, "rob", "v1", 4, 4),
        ("robotics", "c1", "the", 2024, "rob", "v1", 1, 1), ("robotics", "c8", "the", 2024, "rob", "v1", 1, 3),
    ),
)

MATERIALS = Fixture(
    "materials",
    "course_id string, course_role string, source_key string, line int, key string, title string, authors string, edition string, verified boolean, reading_role string",
    (
        ("c1", "must-have", "s1", 0, "isbn:1", "Robots", "Ann Lee", "2", True, "required"),
        ("c2", "supplemental", "s2", 0, "isbn:1", "ROBOTS", "ann lee", "2", True, "Optional"),
        ("c2", "supplemental", "s2", 1, "isbn:1", "Robots", "Ann Lee", "2", False, "required"),
        ("c3", "must-have", "s3", 0, "isbn:1", "Robots", "", "2", True, "assigned"),
        ("c3", "must-have", "s3", 1, "isbn:2", "Archives", "Bo", "", True, "not required"),
        ("c4", "must-have", "s4", 0, "isbn:3", "Loads", "Cy", "1", True, None),
        ("c5", "supplemental", "s5", 0, "isbn:3", "Loads", "Cy", "1", True, "primary"),
        ("c5", "must-have", "s5", 2, "isbn:4", "Scales", "Di", "3", True, "recommended, required for majors"),
    ),
)

NODES = Fixture(
    "nodes",
    "id string, kind string, parent string, source_id string, region_index int, text string, review_state string, fingerprint string, stored string, x double, y double",
    (
        ("r1", "region", "r1", "s1", 0, "Robots need calibrated sensors. Sensors drift.", None, "f1", "f1", 1.0, 0.1),
        ("r2", "region", "r2", "s1", 1, "A chapter on control theory and structures.", None, "f2", "f2", 0.2, 1.0),
        ("r3", "region", "r3", "s1", 2, "Sensors, sensors, sensors: nothing but sensors and robots.", None, "f3", "old", 0.9, 0.3),
        ("r4", "region", "r4", "s1", 3, "", None, "f4", "f4", 0.0, 0.0),
        ("r5", "region", "r5", "s2", 0, "Long original text about archives, too long for a unit. Robots once.", None, "f5", "f5", 0.3, 0.3),
        ("u1", "retrieval-unit", "r5", "s2", None, "Long original text about archives,", None, "f6", "f6", 0.95, 0.2),
        ("u2", "retrieval-unit", "r5", "s2", None, "too long for a unit. Robots once.", None, "f7", "f7", 0.1, -1.0),
        ("r6", "region", "r6", "s2", 1, "The same words as always", None, "f8", "f8", -1.0, 0.0),
        ("k1", "knowledge", "r2", "s1", None, "Sensors drift with heat", "reviewed", "f9", "f9", 0.5, 0.5),
        ("k2", "knowledge", "r6", "s2", None, "Robots and sensors everywhere", "draft", "fa", "fa", 1.0, 0.0),
        ("r7", "region", "r7", "s2", 2, "robots robots robots", None, "fb", "fb", None, None),
        ("r8", "region", "r8", "s2", 3, "Sensors of robots, twins", None, "fc", "fc", 0.9, 0.3),
        ("r9", "region", "r9", "s3", 0, "Sensors of robots, twins", None, "fd", "fd", 0.9, 0.3),
    ),
)

LINKS = Fixture(
    "links",
    "src string, dst string, cosine double, src_fp string, dst_fp string",
    (("r1", "r3", 0.9, "f1", "f3"), ("r3", "r1", 0.95, "f3", "f1"), ("r1", "r5", 0.7, "f1", "f5"), ("r1", "r2", 0.8, "f1", "stale"), ("r8", "r1", 0.7, "fc", "f1"), ("r9", "r1", 0.6, "fd", "f1"), ("r8", "r9", 1.0, "fc", "fd"), ("r6", "r7", 0.5, "gone", "fb")),
)

HEADINGS = Fixture(
    "headings",
    "source_id string, ord int, level int, title string, page int",
    (("s1", 1, 1, "One", 1), ("s1", 2, 2, "One A", 1), ("s1", 3, 3, "Deep", 2), ("s1", 4, 2, "One B", 4), ("s1", 5, 1, "Two", 6), ("s2", 1, 2, "Starts low", 2), ("s2", 2, 1, "Then high", 2), ("s2", 3, 4, "Skips", 3), ("s2", 4, 2, "Back", 3)),
)

PAGE_COUNTS = Fixture("page_counts", "source_id string, pages int", (("s1", 9), ("s2", 3), ("s3", 1)))

CLAIMS = Fixture(
    "claims",
    "claim string, region_id string, quote string",
    (("c1", "r1", "calibrated sensors"), ("c2", "r1", "Calibrated Sensors"), ("c3", "r3", "nothing but sensors"), ("c4", "zz", "robots"), ("c5", "r2", " "), ("c6", "r2", None), ("c7", "r8", "robots, twins")),
)

LISTED = Fixture(
    "listed",
    "course_key string, line int, kind string, title string, citation string, authors string, edition string, isbn string, isbn_validation string, recurrence_key string, association string, eligible boolean, excerpt string, source_field string, book_flag string, library_titles array<string>",
    (
        ("a", 0, "Book", "Signals and Systems", None, "Oppenheim", "2", "0-306-40615-2", "valid checksum", None, None, None, None, None, None, None),
        ("a", 1, "textbook", "Control, ISBN 978-3-16-148410-0", None, "Lee", "", None, None, None, None, None, None, None, "no", None),
        ("a", 2, "e-book", "<b>Robots &amp; Sensors</b>", "Robots. ISBN: 0-8044-2957-X", None, None, None, None, None, None, None, None, None, " TRUE", None),
        ("a", 3, "reading", "Signals", "ISBN 0-306-40615-3 and later ISBN 0306406152", "", "3", None, None, None, None, None, None, None, "t", None),
        ("a", 3, "reading", "Signals", "ISBN 0-306-40615-3 and later ISBN 0306406152", "", "3", None, None, None, None, None, None, None, "t", None),
        ("b", 0, "book", "No textbooks are required for this course.", None, None, None, None, None, None, None, None, None, None, None, None),
        ("b", 1, "book", "None", None, None, None, None, None, None, None, None, None, None, None, None),
        ("b", 2, "book", "All readings on Canvas", None, None, None, None, None, None, None, None, None, None, None, None),
        ("b", 3, "book", "TBA by instructor", None, None, None, None, None, None, None, None, None, None, None, None),
        ("b", 4, "No textbook statement", "Something else", None, None, None, None, None, None, None, None, None, None, None, None),
        ("c", 0, "book", "1. First of all\n2. Second of all", None, None, None, None, None, None, None, None, None, None, None, None),
        ("c", 1, "book", "Two ISBNs: ISBN 9780306406157, ISBN 9783161484100", None, "Ann", "1", None, None, None, None, None, None, None, None, None),
        ("c", 2, "monograph", "A title\n\nand a second one", None, None, None, None, None, None, None, None, None, None, None, None),
        ("c", 3, "workbook", "x" * 281, None, None, None, None, None, None, None, None, None, None, None, None),
        ("c", 4, "book", "", None, None, None, "9780306406157", "valid", None, None, None, None, None, None, None),
        ("c", 5, "book", None, None, None, None, None, None, None, None, None, None, None, None, None),
        ("d", 0, "device", "i>clicker", None, None, None, None, None, None, None, None, None, None, "yes", None),
        ("d", 1, "book", "i-clicker 2 student remote / Macmillan", None, "Macmillan", None, None, None, None, None, None, None, None, None, None),
        ("d", 2, "book", "UNO R3 Super Starter Kit", None, None, None, None, None, None, None, None, None, None, None, None),
        ("d", 3, "book chapter", "Chapter 3 of Loads", None, "Cy", None, None, None, None, None, None, None, None, None, None),
        ("d", 4, "Text_book block", "Loads", None, "Cy", None, None, None, None, None, None, None, None, None, None),
        ("e", 0, "book", "Held at the desk", "Held at the desk. ISBN 9780306406157", None, "4", None, None, None, "library-course-reserve-candidate", None, None, None, None, ["Held at the desk "]),
        ("e", 1, "book", "Canvas prints", None, "Di", None, "9783161484100", None, None, "library-course-reserve-candidate", None, None, None, None, ["Canvas prints"]),
        ("e", 2, "book", "Canvas prints", None, "Di", None, "9783161484100", None, None, None, None, None, None, None, None),
        ("f", 0, "book", "Keyed", None, None, None, None, None, "ISBN:9780306406157", None, None, None, None, None, None),
        ("f", 1, "book", "Keyed wrong", None, None, None, "9780306406158", "valid", None, None, None, None, None, None, None),
        ("f", 2, "book", "Unchecked", None, None, None, "9780306406157", "not checked", None, None, None, None, None, None, None),
        ("f", 3, "book", "Not counted", None, None, None, None, None, None, None, False, "said so", None, None, None),
        ("f", 4, "book", "Catalog description explicitly states a book", None, None, None, None, None, None, None, None, None, "description", None, None),
        ("g", 0, "book", "Text 9990306406157", None, None, None, "2900306406153", "valid", None, None, None, None, None, None, None),
        ("h", 0, "textbook requirement statement", "Required", None, None, None, None, None, None, None, None, None, None, None, None),
    ),
)

LEDGERS = Fixture(
    "ledgers",
    "course_key string, status string, more array<string>, source string, gap string",
    (
        ("a", "found", None, "https://a.example/1", ""), ("a", "searched-no-public-material", None, "https://a.example/2", "later terms"), ("a", "found", None, "https://a.example/1", None),
        ("b", "found", ["ambiguous"], "https://b.example", "b"), ("c", "found", None, None, None), ("d", "searched-no-book-evidence", ["has-saved-reference-records"], "https://d.example", None),
        ("e", "source-access-limited", None, "https://e.example", None), ("g", "zzz-other", ["not-researched"], None, None), ("h", "ambiguous", None, None, None), ("i", "found", None, "https://i.example", None),
    ),
)

LISTED_COURSES = Fixture(
    "listed_courses",
    "course_key string, research_status string, note string, source_url string",
    tuple((k, s, n, u) for k, s, n, u in (
        ("a", None, None, None), ("b", None, None, None), ("c", None, "a note", "https://c.example"), ("d", None, None, None), ("e", None, None, None), ("f", "Found online", None, "https://f.example"),
        ("g", None, None, None), ("h", None, None, None), ("i", None, None, None), ("j", "Login required", "", None), ("k", None, None, "https://k.example"), ("l", "No public material", None, None),
        ("m", "saved reference", None, None), ("n", "not a reference", None, None), ("o", " searched_no book evidence", None, None), ("p", "AMBIGUOUS but found", None, None),
    )),
)

RESOLUTIONS = Fixture(
    "resolutions",
    "course_key string, title string, isbn string, confirmed boolean",
    (("a", "Signals", "9780306406157", True), ("a", "Signals and Systems", "9783161484100", True), ("f", "Keyed", "9780306406157", False), ("f", "Unchecked", "9780306406157", True), ("f", "Keyed wrong", "9780306406157", False), ("zz", "Nothing", "9780306406157", True)),
)
