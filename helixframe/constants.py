"""Values of the DNA layout and of the fingerprint."""

# The format that encoded strands must have.
SEGMENT_BITS = 500
PAYLOAD_NT = 120
ADDRESS_NT = 9
PRIMER_NT = 20
MIN_KEY_LEN = 3
TABLE_CAP = 512
PRIMER_LEFT = "ACGTTGCATGTCAGTACGTA"
PRIMER_RIGHT = "TACGACTGACATGCAACGTT"
FNV_SEED = 1469598103934665603
FNV_PRIME = 1099511628211
FALLBACK = {"00": "GA", "01": "GT", "10": "CA", "11": "CT", "0": "GA", "1": "CA"}
QUATERNARY = {"00": "T", "01": "C", "10": "G", "11": "A"}
MAX_RUN, MAX_END_GC, END_NT = 2, 3, 5

#: Hexadecimal digits of a segment, and of addresses there can be.
SEGMENT_HEX = SEGMENT_BITS // 4
ADDRESSES = 4**ADDRESS_NT
STRAND_NT = 2 * PRIMER_NT + ADDRESS_NT + PAYLOAD_NT
