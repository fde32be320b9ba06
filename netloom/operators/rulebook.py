"""Default detection rules."""

# Ids, texts, severities, tags and thresholds are part of every alert message and must
# stay as they are. A condition is (field, operator, value); all conditions of a rule must hold.
DEFAULT_RULES = [
    dict(id="SYN_FLOOD_001", name="SYN flood", severity="high", enabled=True, tags=["dos", "flood"],
         description="High SYN count with almost no ACKs — classic TCP SYN flood. Attacker exhausts server connection table without completing handshakes.",
         conditions=[("syn_flag_count", "gt", 50), ("ack_flag_count", "lt", 5), ("direction", "eq", "inbound")]),
    dict(id="HIGH_VOLUME_001", name="High-volume flow", severity="high", enabled=True, tags=["dos", "exfil"],
         description="Exceptionally high bytes-per-second rate. Could indicate DDoS amplification, large-scale data exfiltration, or a misconfigured service flooding the network.",
         conditions=[("flow_bytes_per_sec", "gt", 10000000)]),
    dict(id="UDP_FLOOD_001", name="UDP flood", severity="high", enabled=True, tags=["dos", "flood"],
         description="High packet rate with very small average packet size — characteristic of UDP amplification floods (DNS, NTP, memcached).",
         conditions=[("flow_packets_per_sec", "gt", 500), ("avg_packet_len", "lt", 100)]),
    dict(id="PORT_SCAN_001", name="Port scan (RST-based)", severity="medium", enabled=True, tags=["scan"],
         description="Large number of RST packets from one source. Each RST typically means a closed port was probed — strong indicator of a horizontal port scan.",
         conditions=[("rst_flag_count", "gt", 20), ("direction", "eq", "inbound")]),
    dict(id="FIN_SCAN_001", name="FIN scan (stealth)", severity="medium", enabled=True, tags=["scan"],
         description="FIN packets sent without a prior established connection (no SYN, no ACK). Used to bypass stateless firewalls and enumerate open ports quietly.",
         conditions=[("fin_flag_count", "gt", 5), ("syn_flag_count", "eq", 0), ("ack_flag_count", "eq", 0), ("direction", "eq", "inbound")]),
    dict(id="NULL_SCAN_001", name="NULL scan", severity="medium", enabled=True, tags=["scan"],
         description="Flow with zero TCP flags set. No legitimate traffic uses null flags — used by scanners to identify OS type and open ports.",
         conditions=[("syn_flag_count", "eq", 0), ("ack_flag_count", "eq", 0), ("fin_flag_count", "eq", 0), ("rst_flag_count", "eq", 0),
                     ("psh_flag_count", "eq", 0), ("packet_count", "gt", 5), ("direction", "eq", "inbound")]),
    dict(id="C2_BEACON_001", name="C2 beacon (tiny periodic flow)", severity="high", enabled=True, tags=["c2"],
         description="Very few packets, very short duration. Pattern matches known C2 check-in behaviour where malware sends a heartbeat every N seconds.",
         conditions=[("packet_count", "lte", 3), ("duration", "lt", 0.5), ("direction", "eq", "outbound"), ("_dst_port", "not_in", [53, 80, 443, 123])]),
    dict(id="C2_BEACON_002", name="C2 beacon (low-and-slow)", severity="medium", enabled=True, tags=["c2"],
         description="Very long-lived flow with suspiciously low data transfer. Indicates a persistent connection kept alive with minimal traffic — common in RAT (Remote Access Trojan) C2 channels.",
         conditions=[("duration", "gt", 300), ("src_bytes", "lt", 1000), ("direction", "eq", "outbound")]),
    dict(id="BAD_PORT_TELNET", name="Telnet traffic", severity="medium", enabled=True, tags=["suspicious"],
         description="Traffic to port 23 (Telnet). Telnet transmits credentials in plaintext and should not appear on any modern network.",
         conditions=[("_dst_port", "eq", 23), ("direction", "eq", "inbound")]),
    dict(id="BAD_PORT_SMB", name="SMB traffic (port 445)", severity="high", enabled=True, tags=["suspicious"],
         description="Traffic to port 445 (SMB). Historically targeted by EternalBlue, WannaCry, and NotPetya. Inbound 445 should never be allowed from untrusted networks.",
         conditions=[("_dst_port", "eq", 445), ("direction", "eq", "inbound")]),
    dict(id="BAD_PORT_RDP", name="RDP traffic (port 3389)", severity="medium", enabled=True, tags=["suspicious", "bruteforce"],
         description="Traffic to port 3389 (RDP). Frequent target for brute-force and credential-stuffing attacks. Exposed RDP is a top ransomware entry vector.",
         conditions=[("_dst_port", "eq", 3389), ("direction", "eq", "inbound")]),
    dict(id="BAD_PORT_VNC", name="VNC traffic (port 5900)", severity="low", enabled=True, tags=["suspicious"],
         description="Remote desktop via VNC — often misconfigured with weak credentials.",
         conditions=[("_dst_port", "eq", 5900)]),
    dict(id="BAD_PORT_IRC", name="IRC traffic (port 6667)", severity="high", enabled=True, tags=["c2", "suspicious"],
         description="IRC on port 6667 is a classic C2 channel used by botnets. Very few legitimate services use IRC on default ports today.",
         conditions=[("_dst_port", "eq", 6667)]),
    dict(id="BAD_PORT_METERPRETER", name="Metasploit listener (port 4444)", severity="high", enabled=True, tags=["c2", "suspicious"],
         description="Default Metasploit meterpreter reverse-shell listener port.",
         conditions=[("_dst_port", "eq", 4444)]),
    dict(id="BAD_PORT_BACKCONNECT", name="Back Orifice / NetBus", severity="high", enabled=True, tags=["c2", "suspicious"],
         description="Known backdoor ports (31337, 12345) used by legacy RATs.",
         conditions=[("_dst_port", "in", [31337, 12345])]),
    dict(id="BRUTEFORCE_SSH_001", name="SSH brute-force", severity="high", enabled=True, tags=["bruteforce"],
         description="High packet count to port 22 in a short flow. Each connection attempt is a separate TCP handshake — rapid repeated connections indicate a credential-stuffing or dictionary attack against SSH.",
         conditions=[("_dst_port", "eq", 22), ("syn_flag_count", "gt", 20), ("duration", "lt", 30), ("direction", "eq", "inbound")]),
    dict(id="BRUTEFORCE_FTP_001", name="FTP brute-force", severity="medium", enabled=True, tags=["bruteforce"],
         description="Repeated connection attempts against FTP (port 21).",
         conditions=[("_dst_port", "eq", 21), ("syn_flag_count", "gt", 15)]),
    dict(id="EXFIL_LARGE_UPLOAD_001", name="Large outbound upload", severity="medium", enabled=True, tags=["exfil"],
         description="Flow with very high src_bytes but low dst_bytes — asymmetric upload pattern consistent with data exfiltration over a plain TCP channel.",
         conditions=[("src_bytes", "gt", 5000000), ("flow_bytes_per_sec", "gt", 500000), ("direction", "eq", "outbound")]),
    dict(id="ICMP_FLOOD_001", name="ICMP flood", severity="medium", enabled=False, tags=["dos", "flood"],
         description="High-rate small-packet traffic — possible ping flood.",
         conditions=[("flow_packets_per_sec", "gt", 100), ("avg_packet_len", "lt", 80)]),
    dict(id="DNS_EXFIL_001", name="DNS exfiltration (high packet rate)", severity="medium", enabled=False, tags=["exfil", "c2"],
         description="Very high packet rate to port 53. DNS tunnelling tools send many small UDP packets to encode data in DNS query names.",
         conditions=[("dst_port", "eq", 53), ("flow_packets_per_sec", "gt", 50)]),
]
