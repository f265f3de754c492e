"""Training-data pipeline operators.

Nothing outside this folder imports it; the folder can be removed and the rest
of the package keeps working.
"""
