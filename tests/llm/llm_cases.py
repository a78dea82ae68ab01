#: Nulls, empty and blank texts, repeated rows, very long texts and odd characters.
HARD = [None, "", "   \n\t ", "one", "one two three", "same words here again and again", "same words here again and again", "é ü ñ Ж 漢字 \U0001f600", "long " * 30_000, "\n".join(["a line"] * 50), "tab\tand\x0bvertical\x1c odd"]
