"""Header and section decoding against ``struct`` and plain Python, with cut and hostile files."""
import math
import struct
from collections import Counter

import pytest

from sigspark.functions import pe, pe_decode


def image(wide=False, sections=((b".text\0\0\0", 100, 0x1000, 0x200, 0x400, 0x60000020), (b".DATA", 300, 0x2000, 0x100, 0x600, 0xC0000040)),
          lfanew=0x80, machine=0x8664, entry=0x1010, body=b"", characteristics=0x2022, dll=0x8160, stated=None):
    dos = bytearray(struct.pack("<2s13H8x2H20xI", b"MZ", *range(1, 14), 7, 8, lfanew))
    dos += b"\0" * (lfanew - len(dos))
    if wide:
        opt = struct.pack("<HBBIIIII Q II 6H I III HH QQQQ II".replace(" ", ""), 0x20B, 14, 2, 11, 12, 13, entry, 15, (1 << 63) + 5, 0x1000, 0x200,
                          6, 1, 2, 3, 4, 5, 0, 900, 901, 902, 3, dll, (1 << 63) + 1, 22, 23, 24, 0, 16)
    else:
        opt = struct.pack("<HBBIIIIII I II 6H I III HH IIII II".replace(" ", ""), 0x10B, 14, 2, 11, 12, 13, entry, 15, 16, 0x400000, 0x1000, 0x200,
                          6, 1, 2, 3, 4, 5, 0, 900, 901, 902, 2, dll, 21, 22, 23, 24, 0, 16)
    opt += b"\0" * 128
    coff = b"PE\0\0" + struct.pack("<HHIIIHH", machine, len(sections) if stated is None else stated, 123456, 77, 88, len(opt), characteristics)
    table = b"".join(struct.pack("<8sIIII12xI", *s) for s in sections)
    head = bytes(dos) + coff + opt + table
    return head + b"\0" * (0x400 - len(head)) + body


def entropy(data):
    return -sum(c / len(data) * math.log2(c / len(data)) for c in Counter(data).values()) if data else 0.0


BODY = bytes(range(256)) * 2 + b"ab" * 128 + b"overlay!"
FILES = [image(False, body=BODY), image(True, body=BODY), image(machine=0x9999, sections=(), body=b"x"), b"", None, b"MZ", b"ZM" + b"\0" * 80,
         image()[:0x90], image(lfanew=0x80)[:200], b"MZ" + b"\0" * 58 + b"\xff\xff\xff\xff" + b"rest", b"MZ" + b"\0" * 58 + b"\x40\0\0\0" + b"XX\0\0" * 40,
         image(stated=65535, body=BODY), image(entry=0x999999, body=BODY), image(sections=((b"", 1, 1, 0xFFFFFFFF, 0xFFFFFF00, 0x20000000),
                                                                                            (b"\xe9X\0Y", 0, 0xFFFFFFFF, 5, 0x400, 0x20000000)), entry=0x50, body=BODY)]


@pytest.fixture(scope="module")
def decoded(spark):
    df = spark.createDataFrame([(i, None if f is None else bytearray(f), "x") for i, f in enumerate(FILES)], "i int, content binary, header_error string")
    df = df.drop("header_error").repartition(3)
    rows = pe_decode.decode_sections(pe_decode.decode_header(df)).collect()
    return {r.i: r for r in rows}


def test_headers(decoded):
    for i, wide in ((0, False), (1, True)):
        h = decoded[i].header
        assert decoded[i].header_error is None
        assert [h.dos[m] for m in pe.DOS_MEMBERS] == [0x5A4D, *range(1, 14), 7, 8, 0x80]
        assert (h.coff.machine, h.coff.number_of_sections, h.coff.timestamp, h.coff.pointer_to_symbol_table, h.coff.number_of_symbols) == (
            "IMAGE_FILE_MACHINE_AMD64", 2, 123456, 77, 88)
        assert h.coff.characteristics == ["EXECUTABLE_IMAGE", "LARGE_ADDRESS_AWARE", "DLL"]
        assert h.optional.dll_characteristics == ["HIGH_ENTROPY_VA", "DYNAMIC_BASE", "NX_COMPAT", "TERMINAL_SERVER_AWARE"]
        assert h.optional.subsystem == ("IMAGE_SUBSYSTEM_WINDOWS_CUI" if wide else "IMAGE_SUBSYSTEM_WINDOWS_GUI")
        assert int(h.optional.image_base) == ((1 << 63) + 5 if wide else 0x400000)
        assert (h.optional.sizeof_stack_reserve, h.optional.sizeof_stack_commit) == ((1 << 63) - 1 if wide else 21, 22)
        assert (h.optional.sizeof_heap_reserve, h.optional.sizeof_heap_commit, h.optional.number_of_rvas_and_sizes) == (23, 24, 16)
        assert [h.optional[f] for f in ("magic", "major_linker_version", "minor_linker_version", "sizeof_code", "sizeof_initialized_data",
                                        "sizeof_uninitialized_data", "address_of_entrypoint", "base_of_code", "section_alignment",
                                        "major_operating_system_version", "minor_subsystem_version", "sizeof_image", "sizeof_headers", "checksum")] == [
            0x20B if wide else 0x10B, 14, 2, 11, 12, 13, 0x1010, 15, 0x1000, 6, 5, 900, 901, 902]
    assert decoded[2].header.coff.machine == "IMAGE_FILE_MACHINE_UNKNOWN"


def test_files_that_are_no_images(decoded):
    errors = {i: decoded[i].header_error for i in range(3, 11)}
    assert errors == {3: "shorter than a DOS header", 4: "shorter than a DOS header", 5: "shorter than a DOS header", 6: "no DOS signature",
                      7: "header lies beyond the end", 8: "header is cut off", 9: "header lies beyond the end", 10: "no PE signature"}
    assert all(decoded[i].header is None and decoded[i].section is None and decoded[i].section_error == errors[i] for i in errors)


def test_sections(decoded):
    for i in (0, 1):
        s = decoded[i].section
        n = len(FILES[i])
        assert decoded[i].section_error is None and s.entry == ".text" and [x.name for x in s.sections] == [".text", ".data"]
        first, second = s.sections
        assert (first.size, first.vsize, first.size_ratio, first.vsize_ratio) == (0x200, 100, 0x200 / n, 0x200 / 100)
        assert first.entropy == pytest.approx(8.0) and second.entropy == pytest.approx(1.0)
        assert first.props == ["CNT_CODE", "MEM_EXECUTE", "MEM_READ"] and second.props == ["CNT_INITIALIZED_DATA", "MEM_READ", "MEM_WRITE"]
        assert (s.overlay.size, s.overlay.size_ratio) == (8, 8 / n) and s.overlay.entropy == pytest.approx(entropy(b"overlay!"))
    assert decoded[12].section.entry == ".text"                                    # no section holds the entry point: the first executable one
    assert decoded[2].section.sections == [] and decoded[2].section.entry == ""


def test_hostile_section_tables(decoded):
    many = decoded[11]
    whole = (len(FILES[11]) - 0x80 - 24 - 96 - 128) // 40
    assert many.section_error == f"only {whole} of 65535 section records are whole" and len(many.section.sections) == whole
    odd = decoded[13].section
    assert [x.name for x in odd.sections] == ["", "x\0y"] and odd.entry == "x\0y"
    assert odd.sections[0].entropy == 0.0 and odd.sections[0].size_ratio == 0xFFFFFFFF / len(FILES[13])


def test_decoded_headers_feed_the_vectors(spark):
    df = spark.createDataFrame([(bytearray(image(True, body=BODY)),)], "content binary")
    d = pe_decode.decode_header(df)
    v = d.select(pe.header_vec(d["header"]).alias("v")).first()["v"]
    assert len(v) == 74 and v[0] == 123456.0
