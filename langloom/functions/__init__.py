"""Column expressions: characters, hashes, quantisation, small text helpers."""
