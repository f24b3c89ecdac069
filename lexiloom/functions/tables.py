"""Constant tables: script blocks, digits, the code points assigned in Unicode 15.1, and control tokens.

The assigned code points are frozen here, so that vocabulary ids do not move with an interpreter's Unicode version.
"""

from __future__ import annotations

_NAMES = "devanagari bengali gurmukhi gujarati oriya tamil telugu kannada malayalam sinhala".split()
#: (script, first, last) in the order in which vocabularies are seeded.
SCRIPTS: tuple[tuple[str, int, int], ...] = (
    *((name, 0x900 + 128 * k, 0x97F + 128 * k) for k, name in enumerate(_NAMES)),
    *(("tibetan", 0xF00, 0xFFF), ("devanagari_ext", 0xA8E0, 0xA8FF), ("vedic_ext", 0x1CD0, 0x1CFF)),
)
#: Decimal digits of the nine scripts that have their own at offset 0x66 of the block.
DIGITS: tuple[tuple[str, int, int], ...] = tuple((f"{name}_digits", first + 0x66, first + 0x6F) for name, first, _ in SCRIPTS[:9])

_ASSIGNED = (
    "900-97f 980-983 985-98c 98f-990 993-9a8 9aa-9b0 9b2 9b6-9b9 9bc-9c4 9c7-9c8 9cb-9ce 9d7 9dc-9dd 9df-9e3 "
    "9e6-9fe a01-a03 a05-a0a a0f-a10 a13-a28 a2a-a30 a32-a33 a35-a36 a38-a39 a3c a3e-a42 a47-a48 a4b-a4d a51 "
    "a59-a5c a5e a66-a76 a81-a83 a85-a8d a8f-a91 a93-aa8 aaa-ab0 ab2-ab3 ab5-ab9 abc-ac5 ac7-ac9 acb-acd ad0 "
    "ae0-ae3 ae6-af1 af9-aff b01-b03 b05-b0c b0f-b10 b13-b28 b2a-b30 b32-b33 b35-b39 b3c-b44 b47-b48 b4b-b4d "
    "b55-b57 b5c-b5d b5f-b63 b66-b77 b82-b83 b85-b8a b8e-b90 b92-b95 b99-b9a b9c b9e-b9f ba3-ba4 ba8-baa bae-bb9 "
    "bbe-bc2 bc6-bc8 bca-bcd bd0 bd7 be6-bfa c00-c0c c0e-c10 c12-c28 c2a-c39 c3c-c44 c46-c48 c4a-c4d c55-c56 "
    "c58-c5a c5d c60-c63 c66-c6f c77-c7f c80-c8c c8e-c90 c92-ca8 caa-cb3 cb5-cb9 cbc-cc4 cc6-cc8 cca-ccd cd5-cd6 "
    "cdd-cde ce0-ce3 ce6-cef cf1-cf3 d00-d0c d0e-d10 d12-d44 d46-d48 d4a-d4f d54-d63 d66-d7f d81-d83 d85-d96 "
    "d9a-db1 db3-dbb dbd dc0-dc6 dca dcf-dd4 dd6 dd8-ddf de6-def df2-df4 f00-f47 f49-f6c f71-f97 f99-fbc fbe-fcc "
    "fce-fda a8e0-a8ff 1cd0-1cfa "
)


def _runs(text: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b or a, 16)) for a, _, b in (x.partition("-") for x in text.split())]


#: Runs of assigned code points of SCRIPTS, in their order.
ASSIGNED: tuple[tuple[int, int], ...] = tuple(_runs(_ASSIGNED))

_CONTROL = """
endoftext startoftext bos eos pad unk
im_start im_end system user assistant human
eot_id start_header_id end_header_id
fim_prefix fim_middle fim_suffix
tool_use tool_result tool_call
thinking /thinking
citation
cls sep mask
"""
#: Control tokens in the order of their ids.
SPECIAL_TOKENS: tuple[str, ...] = tuple(f"<|{name}|>" for name in _CONTROL.split())
END_OF_TEXT, UNKNOWN = "<|endoftext|>", "<|unk|>"
#: Tokens of a vocabulary, unless a caller says otherwise.
DEFAULT_SIZE = 16_000
