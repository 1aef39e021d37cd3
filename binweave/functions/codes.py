"""Names of codes and flags of the file formats: ENUMS and FLAGS by table, each code to name, and DataFrames for joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from binweave.functions.bytes_expr import enum_name, flag_names

# Codes of the formats and the names that results use for them, one table per line.
_ENUMS = """
MachineType: Unknown=0x0000 AlphaAxp=0x0184 Alpha64=0x0284 MatsushitaAm33=0x01D3 Amd64=0x8664 Arm=0x01C0 Arm64=0xAA64 ArmThumb2=0x01C4 EfiByteCode=0x0EBC I386=0x014C Itanium=0x0200 LoongArch32=0x6232 LoongArch64=0x6264 MitsubishiM32r=0x9041 Mips16=0x0266 MipsWithFpu=0x0366 Mips16WithFpu=0x0466 PowerPc=0x01F0 PowerPcWithFpu=0x01F1 MipsR3kBigEndian=0x0160 MipsR3kLittleEndian=0x0162 MipsR4k=0x0166 MipsR10k=0x0168 RiscV32=0x5032 RiscV64=0x5064 RiscV128=0x5128 HitachiSh3=0x01A2 HitachiSh3Dsp=0x01A3 HitachiSh4=0x01A6 HitachiSh5=0x01A8 ArmThumb=0x01C2 WceMipsV2=0x0169
Subsystem: Unknown=0 Native=1 WindowsGui=2 WindowsCui=3 Os2Cui=5 PosixCui=7 NativeWindows=8 WindowsCeGui=9 EfiApplication=10 EfiBootServiceDriver=11 EfiRuntimeDriver=12 EfiRom=13 Xbox=14 WindowsBootApplication=16
Compression: Rgb=0 Rle8=1 Rle4=2 BitFields=3 Jpeg=4 Png=5 AlphaBitFields=6
MemberAccess: NoProtection=0 Private=1 Protected=2 Public=3
MethodProperty: Vanilla=0 Virtual=1 Static=2 Friend=3 IntroducingVirtual=4 PureVirtual=5 PureIntroducingVirtual=6 Reserved=7
PointerKind: Near=0 Far=1 Huge=2 BasedOnSegment=3 BasedOnValue=4 BasedOnValueSegment=5 BasedOnSymbolAddress=6 BasedOnSymbolAddressSegment=7 BasedOnType=8 BasedOnSelf=9 Near32=10 Far32=11
PointerMode: Pointer=0 Reference=1 DataMemberPointer=2 MethodPointer=3
PointerToMemberFormat: Data16_16VirtualNone=0 Data16_16VirtualFunctions=1 Data16_16VirtualBases=2 Data16_32VirtualNoneOrFunctions=3 Data16_32VirtualBases=4 NearMethod16_16SingleAddressPoint=5 NearMethod16_16MultipleAddressPoints=6 NearMethod16_16VirtualBases=7 FarMethod16_16SingleAddressPoint=8 FarMethod16_16MultipleAddressPoints=9 FarMethod16_16VirtualBases=10 Method16_32SingleAddressPoint=11 Method16_32MultipleAddressPoints=12 Method16_32VirtualBases=13
CallingConvention: NearC=0 FarC=1 NearPascal=2 FarPascal=3 NearFastcall=4 FarFastcall=5 NearStdcall=7 FarStdcall=8 NearSyscall=9 FarSyscall=10 ThisCall=11 MipsCall=12 Generic=13
VirtualFunctionTableShapeDescriptor: Near=0 Far=1 Thin=2 AddressPointDisplacementToOutermostClass=3 FarPointerToMetaclassDescriptor=4 Near32=5 Far32=6
Machine: Intel8080=0x00 Intel8086=0x01 Intel80286=0x02 Intel80386=0x03 Intel80486=0x04 IntelPentium=0x05 MipsR4000=0x10 MipsFuture1=0x11 MipsFuture2=0x12 Mc68000=0x20 Mc68010=0x21 Mc68020=0x22 Mc68030=0x23 Mc68040=0x24 DecAlpha=0x30
Language: C=0 CPlusPlus=1 Fortran=2 Masm=3 Pascal=4 Basic=5 Cobol=6 Link=7 CvtRes=8 CvtPgd=9 CSharp=10 VisualBasic=11 ILAsm=12 Java=13 JScript=14 Msil=15 Hlsl=16
FloatPrecision: AnsiC=1
FloatPackage: Hardware=0 Emulator=1 Altmath=2
AmbientMemoryModel: Near=0 Far=1 Huge=2
ReturnStyle: VoidReturn=0 RegistersInData=1 IndirectCallerAllocatedNear=2 IndirectCallerAllocatedFar=3 IndirectCalleeAllocatedNear=4 IndirectCalleeAllocatedFar=5
ThunkType: NoType=0 Adjustor=1 VirtualCall=2 PCode=3
ExecutionModel: NotExecutable=0x00 CompilerGeneratedJumpTable=0x01 DataPadding=0x02 NativeModel=0x20 MicrofocusCobol=0x21 CodePadding=0x22 Code=0x23 PCode=0x40
FixupType: FiarqqFjarqq=1 FisrqqFjsrqq=2 FicrqqFjcrqq=3 Fierqq=4 Fidrqq=5 Fiwrqq=6
RelocationEntrySourceType: LowByte=0 Segment=2 FarAddress=3 Offset=5
RelocationEntryTargetType: InternalReference=0 ImportOrdinal=1 ImportName=2 OperatingSystemFixup=3
DebugType: Unknown=0 Coff=1 CodeView=2 FramePointerOmission=3 DbgFileLocation=4 Exception=5 Fixup=6 OmapToSource=7 OmapFromSource=8 Borland=9 Clsid=11 Reproducibility=16 EmbeddedData=17 SymbolFileHash=19 ExtendedDllCharacteristics=20
CompressionType: NoCompression=0 MsZip=1 Quantum=2 Lzx=3
FolderIndex: ContinuedFromPrevious=0xFFFD ContinuedToNext=0xFFFE ContinuedPreviousAndNext=0xFFFF
DescriptorType: BootRecord=0 PrimaryVolumeDescriptor=1 SupplementaryOrEnhancedVolumeDescriptor=2 VolumePartitionDescriptor=3 SetTerminator=0xFF
Family: DontCare=0 Roman=1 Swiss=2 Modern=3 Script=4 Decorative=5
"""
_FLAGS = """
Characteristics: RELOCS_STRIPPED=0x0001 EXECUTABLE_IMAGE=0x0002 LINE_NUMS_STRIPPED=0x0004 LOCAL_SYMS_STRIPPED=0x0008 AGGRESSIVE_WS_TRIM=0x0010 LARGE_ADDRESS_AWARE=0x0020 BYTES_REVERSED_LO=0x0080 IS_32BIT_MACHINE=0x0100 DEBUG_STRIPPED=0x0200 REMOVABLE_RUN_FROM_SWAP=0x0400 NET_RUN_FROM_SWAP=0x0800 SYSTEM=0x1000 DLL=0x2000 UP_SYSTEM_ONLY=0x4000 BYTES_REVERSED_HI=0x8000
DllCharacteristics: HIGH_ENTROPY_VIRTUAL_ADDRESSES=0x0020 DYNAMIC_BASE=0x0040 FORCE_INTEGRITY=0x0080 NX_COMPATIBILITY=0x0100 NO_ISOLATION=0x0200 NO_SEH=0x0400 NO_BIND=0x0800 APPCONTAINER=0x1000 WDM_DRIVER=0x2000 GUARD_CF=0x4000 TERMINAL_SERVER_AWARE=0x8000
SectionCharacteristics: NO_PAD=0x00000008 CONTAINS_CODE=0x00000020 CONTAINS_INITIALIZED_DATA=0x00000040 CONTAINS_UNINITIALIZED_DATA=0x00000080 LINK_OTHER=0x00000100 LINK_INFO=0x00000200 LINK_REMOVE=0x00000800 LINK_COMMON_DATA=0x00001000 GLOBAL_POINTER_RELATIVE=0x00008000 MEM_PURGEABLE=0x00008000 MEM_LOCKED=0x00040000 MEM_PRELOAD=0x00080000 ALIGN_BYTES_SHIFT_COUNT_1=0x00100000 ALIGN_BYTES_SHIFT_COUNT_2=0x00200000 ALIGN_BYTES_SHIFT_COUNT_4=0x00400000 ALIGN_BYTES_SHIFT_COUNT_8=0x00800000 LINK_NRELOC_OVFL=0x01000000 MEM_DISCARDABLE=0x02000000 MEM_NOT_CACHED=0x04000000 MEM_NOT_PAGED=0x08000000 MEM_SHARED=0x10000000 MEM_EXECUTE=0x20000000 MEM_READ=0x40000000 MEM_WRITE=0x80000000
TypeFlags: VECTOR=0x0001 AT_OFFSET=0x0004 REALIZED_BY_DEVICE=0x0080
FontFlags: FIXED=0x0001 PROPORTIONAL=0x0002 ABC_FIXED=0x0004 ABC_PROPORTIONAL=0x0008 COLORS_1=0x0010 COLORS_16=0x0020 COLORS_256=0x0040 COLORS_RGB=0x0080
Italic: ITALIC=0x01
Underline: UNDERLINE=0x01
StrikeOut: STRIKE_OUT=0x01
ClrFlags: CLR_ONLY=0x0001
ModifierTypeAttributes: CONST=0x0001 VOLATILE=0x0002 UNALIGNED=0x0004
StructureProperties: PACKED=0x0001 CONSTRUCTOR_DESTRUCTOR=0x0002 OVERLOADED_OPERATORS=0x0004 NESTED=0x0008 CONTAINS_NESTED=0x0010 OVERLOADED_ASSIGNMENT=0x0020 CASTING_METHODS=0x0040 FORWARD_REFERENCE=0x0080 SCOPED=0x0100
SegmentDescriptorFlags: READ=0x0001 WRITE=0x0002 EXECUTE=0x0004 LINEAR_ADDRESS_32=0x0008 SELECTOR=0x0100 ABSOLUTE_ADDRESS=0x0200 GROUP=0x1000
FunctionFlags: C_STYLE=0x0001 CALLEE_STACK_CLEANUP=0x0002
ProcedureFlags: FRAME_POINTER_OMITTED=0x01 IS_INTERRUPT_ROUTINE=0x02 PERFORMS_FAR_RETURN=0x04 NEVER_RETURNS=0x08
ExeFlags: SINGLE_DATA=0x0001 MULTIPLE_DATA=0x0002 GLOBAL_INIT=0x0004 PROTECTED_MODE_ONLY=0x0008 INSTRUCTIONS_8086=0x0010 INSTRUCTIONS_286=0x0020 INSTRUCTIONS_386=0x0040 INSTRUCTIONS_FPU=0x0080 LINK_ERRORS=0x2000 LIBRARY_MODULE=0x8000
SegmentFlags: DATA=0x0001 MOVEABLE=0x0010 PRELOAD=0x0040 HAS_RELOCATION_INFO=0x0100 DISCARD=0xF000
ResourceFlags: MOVEABLE=0x0010 PURE=0x0020 PRELOAD=0x0040
SegmentEntryFlags: EXPORTED=0x01 SHARED_DATA=0x02
RelocationEntryFlags: ADDITIVE=0x04
CabFlags: PREV_CABINET=0x0001 NEXT_CABINET=0x0002 RESERVE_PRESENT=0x0004
FileInCabAttributes: READ_ONLY=0x0001 HIDDEN=0x0002 SYSTEM=0x0004 ARCHIVE=0x0020 EXECUTE=0x0040 UTF8_NAME=0x0080
Attributes: READ_ONLY=0x01 HIDDEN=0x02 SYSTEM=0x04 VOLUME_LABEL=0x08 SUBDIRECTORY=0x10 ARCHIVE=0x20 DEVICE=0x40 RESERVED=0x80
FileFlags: EXISTENCE=0x01 DIRECTORY=0x02 ASSOCIATED_FILE=0x04 RECORD=0x08 PROTECTION=0x10 MULTI_EXTENT=0x80
VolumeFlags: CONTAINS_NON_ISO_2375_ESCAPE_SEQUENCE=0x01
Permissions: FORBID_SYSTEM_READ=0x0001 RESERVED1=0x0002 FORBID_SYSTEM_EXECUTE=0x0004 RESERVED3=0x0008 FORBID_OWNER_READ=0x0010 RESERVED5=0x0020 FORBID_OWNER_EXECUTE=0x0040 RESERVED7=0x0080 FORBID_GROUP_READ=0x0100 RESERVED9=0x0200 FORBID_GROUP_EXECUTE=0x0400 RESERVED11=0x0800 FORBID_OTHER_READ=0x1000 RESERVED13=0x2000 FORBID_OTHER_EXECUTE=0x4000 RESERVED15=0x8000
"""


def _tables(text: str) -> dict[str, list[tuple[int, str]]]:
    out = {}
    for line in text.strip().splitlines():
        name, _, pairs = line.partition(": ")
        out[name] = [(int(v, 0), k) for k, v in (p.split("=") for p in pairs.split())]
    return out


ENUMS: dict[str, dict[int, str]] = {k: dict(v) for k, v in _tables(_ENUMS).items()}
FLAGS: dict[str, list[tuple[int, str]]] = _tables(_FLAGS)


def enum_text(table: str, code: Column | str) -> Column:
    """The name of a code, Other(n) where it has none, null for null."""
    return enum_name(code, ENUMS[table], other=True)


def flags_text(table: str, bits: Column | str) -> Column:
    """The names of the flags that are set. Where two names share a bit, the first is used."""
    seen: dict[int, str] = {}
    for b, n in FLAGS[table]:
        seen.setdefault(b, n)
    return flag_names(bits, seen)


def code_table(spark: SparkSession) -> DataFrame:
    """(table_name, is_flag, code, name) of all tables: a few hundred rows, for joins."""
    rows = [(t, False, c, n) for t, d in ENUMS.items() for c, n in d.items()] + [(t, True, c, n) for t, d in FLAGS.items() for c, n in d]
    return spark.createDataFrame(rows, "table_name string, is_flag boolean, code bigint, name string")
