"""Small input frames under the source's own column names."""

from termgrid.spec import GRADE_POINTS

TEXT = {
    "Year": "2021", "Term": "spring", "YearTerm": "2021-sp", "Subject": "CS", "Number": "101",
    "Course Title": "Intro", "Sched Type": "Lecture", "Primary Instructor": "A", "W": "0", "Students": "10",
    **{grade: "0" for grade in GRADE_POINTS},
}


def grade_frame(spark, rows):
    """Raw grade rows; every column is text, as read from CSV."""
    filled = [{**TEXT, **{k: None if v is None else str(v) for k, v in row.items()}} for row in rows]
    schema = ", ".join(f"`{c}` string" for c in TEXT)
    return spark.createDataFrame([tuple(r[c] for c in TEXT) for r in filled], schema)


def metrics_frame(spark, rows):
    """Course-term rows with typed counts."""
    base = {"year": 2021, "term": "spring", "subject": "CS", "number": "101", "title": "Intro", "students": 10.0, "w": 0.0}
    schema = "year int, term string, subject string, number string, title string, students double, w double"
    filled = [{**base, **row} for row in rows]
    return spark.createDataFrame([tuple(r[c] for c in base) for r in filled], schema)


def six_year_rows():
    return [
        {"Year": y, "Term": t, "Number": 101, "Students": 10 + y - 2019, "W": y % 2, "A": 5, "B": 5}
        for y in range(2019, 2025) for t in ("Spring", "Fall")
    ]


def records(df, *order):
    rows = [r.asDict() for r in df.collect()]
    return sorted(rows, key=lambda r: tuple(str(r[c]) for c in order)) if order else rows
