"""The 151 documented 6502 opcodes and mnemonic classes, as dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The opcode matrix is regular, so it is stated by its rows (aaa) and columns (bbb).
_COL1 = ("indx", "zp", "imm", "abs", "indy", "zpx", "absy", "absx")
_ROW1 = ("ora", "and", "eor", "adc", "sta", "lda", "cmp", "sbc")
_ROW2 = ("asl", "rol", "lsr", "ror", "stx", "ldx", "dec", "inc")
_BRANCH = ("bpl", "bmi", "bvc", "bvs", "bcc", "bcs", "bne", "beq")
_IMPLIED = {
    0x00: "brk", 0x40: "rti", 0x60: "rts", 0x08: "php", 0x18: "clc", 0x28: "plp", 0x38: "sec", 0x48: "pha", 0x58: "cli",
    0x68: "pla", 0x78: "sei", 0x88: "dey", 0x98: "tya", 0xA8: "tay", 0xB8: "clv", 0xC8: "iny", 0xD8: "cld", 0xE8: "inx",
    0xF8: "sed", 0x8A: "txa", 0x9A: "txs", 0xAA: "tax", 0xBA: "tsx", 0xCA: "dex", 0xEA: "nop",
}
_OTHER = {
    0x20: ("jsr", "abs"), 0x4C: ("jmp", "abs"), 0x6C: ("jmp", "ind"), 0x24: ("bit", "zp"), 0x2C: ("bit", "abs"),
    0x84: ("sty", "zp"), 0x8C: ("sty", "abs"), 0x94: ("sty", "zpx"), 0xA0: ("ldy", "imm"), 0xA4: ("ldy", "zp"),
    0xAC: ("ldy", "abs"), 0xB4: ("ldy", "zpx"), 0xBC: ("ldy", "absx"), 0xC0: ("cpy", "imm"), 0xC4: ("cpy", "zp"),
    0xCC: ("cpy", "abs"), 0xE0: ("cpx", "imm"), 0xE4: ("cpx", "zp"), 0xEC: ("cpx", "abs"),
}
SIZE = {"imp": 1, "acc": 1, "imm": 2, "zp": 2, "zpx": 2, "zpy": 2, "indx": 2, "indy": 2, "rel": 2, "abs": 3, "absx": 3, "absy": 3, "ind": 3}

BRANCHES = (*_BRANCH, "bra")
STORES = ("sta", "stx", "sty", "stz")
LOADS = ("lda", "ldx", "ldy", "cmp", "cpx", "cpy", "bit", "and", "ora", "eor", "adc", "sbc")
MODIFIES = ("inc", "dec", "asl", "lsr", "rol", "ror")
RETURNS, JUMPS, CALLS, HALTS = ("rts", "rti"), ("jmp",), ("jsr",), ("brk",)
TERMINATORS = (*RETURNS, *HALTS, *JUMPS)


def opcodes() -> dict[int, tuple[str, str]]:
    """opcode: (mnemonic, mode) of every documented opcode."""
    table = {op: (m, "imp") for op, m in _IMPLIED.items()} | dict(_OTHER)
    table |= {0x10 + 0x20 * i: (m, "rel") for i, m in enumerate(_BRANCH)}
    for a, m in enumerate(_ROW1):
        table |= {a << 5 | b << 2 | 1: (m, mode) for b, mode in enumerate(_COL1) if (m, mode) != ("sta", "imm")}
    for a, m in enumerate(_ROW2):
        swap = m in ("stx", "ldx")
        for b, mode in ((1, "zp"), (3, "abs"), (5, "zpy" if swap else "zpx"), (7, "absy" if swap else "absx")):
            if (m, mode) != ("stx", "absy"):
                table[a << 5 | b << 2 | 2] = (m, mode)
        if a < 4:
            table[a << 5 | 0x0A] = (m, "acc")
    table[0xA2] = ("ldx", "imm")
    return table


def opcode_dim(spark: SparkSession) -> DataFrame:
    """``opcode, mnemonic, mode, size``: 151 rows."""
    return spark.createDataFrame([(op, m, mode, SIZE[mode]) for op, (m, mode) in sorted(opcodes().items())], "opcode int, mnemonic string, mode string, size int")


def access_kind(mnemonic):
    """Column: w, rmw or r; null for instructions that touch no memory operand."""
    from pyspark.sql import functions as F

    m = F.lower(mnemonic)
    return F.when(m.isin(*STORES), "w").when(m.isin(*MODIFIES), "rmw").when(m.isin(*LOADS), "r")
