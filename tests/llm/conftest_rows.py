"""Rows as sortable tuples."""


def clean(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple(str(x) for x in r))
