"""Rows as comparable tuples, whatever made them."""


def rows_of(frame, columns):
    frame = frame[columns].astype(object)
    values = frame.where(frame.notna(), None).values.tolist()
    return sorted((tuple(r) for r in values), key=lambda r: tuple(str(x) for x in r))
