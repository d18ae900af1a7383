"""The binary log container, in plain Python: headers, records, carving, repair, writing, decoding."""
